"""Scans, sinks, adapters to the common schema and file inventories."""
