"""Column expressions: parsing, units, bounds, classification, ids, draws."""
