"""Qualified (censored) values: relations, numbers, units, bounds and scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions.text import as_col, clean

# The relation vocabulary and its accepted spellings.
RELATIONS = ("=", "<", "<=", ">", ">=", "~")
RELATION_SPELLINGS = {"==": "=", "=<": "<=", "=>": ">=", "≤": "<=", "≥": ">=", "≈": "~"}

# Factors that bring a normalised concentration unit to nanomolar.
CONCENTRATION_TO_NANO = {
    "pm": 0.001,
    "pmol/l": 0.001,
    "pmol/liter": 0.001,
    "picomolar": 0.001,
    "nm": 1.0,
    "nmol/l": 1.0,
    "nmol/liter": 1.0,
    "nanomolar": 1.0,
    "um": 1000.0,
    "umol/l": 1000.0,
    "umol/liter": 1000.0,
    "micromolar": 1000.0,
    "mm": 1000000.0,
    "mmol/l": 1000000.0,
    "mmol/liter": 1000000.0,
    "millimolar": 1000000.0,
    "m": 1000000000.0,
    "mol/l": 1000000000.0,
    "mol/liter": 1000000000.0,
    "molar": 1000000000.0,
}

# Tokens read as "no value", and tokens read as unbounded.
MISSING_TOKENS = ("", "-", "na", "n/a", "nan", "nd", "none", "not reported", "not determined")
INFINITY_TOKENS = ("∞", "+∞", "inf", "+inf", "infinity", "+infinity")

NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
STRICT_NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"


def lookup(c: Column, table: dict) -> Column:
    """Value of a small literal table at ``c`` (NULL when absent)."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def finite(c: Column) -> Column:
    """NULL for NaN and infinities, so no later comparison sees them."""
    return F.when(F.abs(F.nanvl(c, F.lit(None).cast("double"))) < float("inf"), c)


#: The characters of a regular expression's white space; F.translate removes them at a fraction of the cost.
BLANKS = " \t\n\x0b\f\r"


def once(c: Column, f) -> Column:
    """``f`` of a value that is made once a row, however often ``f`` names it.

    Higher-order functions are evaluated outside whole-stage code.  A chain of parsing steps inlined there grows beyond
    the 8,000 bytes up to which the JVM compiles a method, and is then interpreted for every row.
    """
    return F.get(F.transform(F.array(c), f), F.lit(0))


# The expressions below name each input once.  Filters are pushed through projections by
# substitution, so an input named twice per level would double the generated code per level.


def spell_relation(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">="))
    whole = {k: v for k, v in RELATION_SPELLINGS.items() if k not in "≤≥"}
    return once(out, lambda x: F.coalesce(lookup(x, whole), x))


def normalize_relation(c) -> Column:
    return spell_relation(F.translate(clean(c), BLANKS, ""))


def relation_text(value, explicit) -> Column:
    """The explicit relation without blanks, else the prefix of the value text, as written."""
    both = F.concat(F.translate(clean(explicit), BLANKS, ""), F.lit("\n"), clean(value))
    return F.regexp_extract(both, r"^(?:\n\s*)?((?<!\s)[^\n]+|[<>]=?|=|~|≤|≥|≈)", 1)


def extract_relation(value, explicit) -> Column:
    """Explicit relation when present, else the prefix of the value text, else ``=``."""
    return once(spell_relation(relation_text(value, explicit)), lambda x: F.when(x == "", "=").otherwise(x))


def number_text(c) -> Column:
    """First numeric token as a double, possibly infinite."""
    token = F.regexp_extract(F.replace(clean(c), F.lit(","), F.lit("")), NUMBER, 0)
    return once(token, lambda x: F.when(x != "", x.try_cast("double")))  # a failed cast costs an exception


def parse_numeric(c) -> Column:
    """First numeric token of a text, thousands commas ignored; NULL when there is none."""
    return once(number_text(c), lambda x: F.when(F.abs(x) < float("inf"), x))


def with_qualified(df: DataFrame, column: str, out: str = "qualified") -> DataFrame:
    """Attach struct(value, relation, censoring, lower_bound, upper_bound, annotation, status).

    Built in stages of plain columns so each regular expression is evaluated once per row and the
    generated code stays small.
    """
    span = rf"(?i)^\s*({STRICT_NUMBER})\s*(?:-|–|to)\s*({STRICT_NUMBER})\s*$"
    head = rf"^\s*({STRICT_NUMBER})\s*(.*)$"
    lead = r"^\s*(<=|>=|<|>|~|≈|=)?\s*"
    raw = clean(column)
    text = F.replace(F.replace(raw, F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">="))
    d = df.withColumns({"__raw": raw, "__text": F.replace(text, F.lit("−"), F.lit("-"))})
    token = F.regexp_extract("__text", lead, 1)
    d = d.withColumns(
        {
            "__rel": F.when(token == "", "=").when(token == "≈", "~").otherwise(token),
            "__rest": F.trim(F.regexp_replace("__text", lead, "")),
            "__low": F.lower("__raw"),
        }
    )
    d = d.withColumn("__plain", F.replace("__rest", F.lit(","), F.lit("")))
    d = d.withColumns(
        {
            "__a": F.nullif(F.regexp_extract("__rest", span, 1), F.lit("")).try_cast("double"),
            "__b": F.nullif(F.regexp_extract("__rest", span, 2), F.lit("")).try_cast("double"),
            "__num": F.nullif(F.regexp_extract("__plain", head, 1), F.lit("")).try_cast("double"),
            "__note": F.nullif(F.trim(F.regexp_extract("__plain", head, 2)), F.lit("")),
        }
    )
    c = F.col
    d = d.withColumn(
        "__status",
        F.when(c("__low").isin(*MISSING_TOKENS), "missing")
        .when(c("__low").isin(*INFINITY_TOKENS), "unbounded_right_censored")
        .when((c("__rel") == "=") & c("__a").isNotNull() & c("__b").isNotNull(), "interval")
        .when(c("__num").isNull(), "unparsed")
        .when(finite(c("__num")).isNull(), "nonfinite")
        .otherwise("parsed"),
    )
    parsed, span_row = c("__status") == "parsed", c("__status") == "interval"
    open_row = c("__status") == "unbounded_right_censored"
    side = F.when(c("__rel").isin("<", "<="), "left").when(c("__rel").isin(">", ">="), "right").otherwise("none")
    q = F.struct(
        F.when(parsed, c("__num")).alias("value"),
        F.when(parsed, c("__rel")).when(span_row, "~").when(open_row, ">").otherwise("not_reported").alias("relation"),
        F.when(parsed, side)
        .when(span_row, "interval")
        .when(c("__status") == "missing", "missing")
        .when(open_row, "right")
        .otherwise("unknown")
        .alias("censoring"),
        F.when(span_row, F.least("__a", "__b")).alias("lower_bound"),
        F.when(span_row, F.greatest("__a", "__b")).alias("upper_bound"),
        F.when(parsed, c("__note")).when(c("__status") == "unparsed", c("__raw")).alias("annotation"),
        c("__status").alias("status"),
    )
    return d.withColumn(out, q).select(*df.columns, out)


def normalize_unit(c) -> Column:
    """Unit spelling in canonical form; a missing unit stays '' and is never guessed."""
    t = F.lower(F.translate(clean(c), "µμΜ−·" + BLANKS, "uuu-."))
    t = F.regexp_replace(t, r"\.?l(\^-?1|-1)$", "/l")
    return F.replace(t, F.lit("/litre"), F.lit("/liter"))


def unit_factor(c, table: dict = CONCENTRATION_TO_NANO) -> Column:
    return lookup(normalize_unit(c), table)


def unit_status(c, table: dict = CONCENTRATION_TO_NANO) -> Column:
    u = normalize_unit(c)
    return (
        F.when(u == "", "missing_unit").when(u.isin(*table), "converted").otherwise("unsupported_unit")
    )


def p_value(nano) -> Column:
    """9 - log10(nanomolar value); NULL when not positive (log10 is NULL there)."""
    return F.lit(9.0) - F.log10(as_col(nano))


def censoring_direction(relation) -> Column:
    r = as_col(relation)
    return (
        F.when(r.isin("<", "<="), "left")
        .when(r.isin(">", ">="), "right")
        .when(r == "~", "approximate")
        .when(r == "=", "none")
        .otherwise("invalid")
    )


def bounds(value, relation) -> tuple[Column, Column]:
    """(lower, upper) implied by a relation; an open side is NULL."""
    v, r = as_col(value), as_col(relation)
    return (
        F.when(r.isin("=", "~", ">", ">="), v),
        F.when(r.isin("=", "~", "<", "<="), v),
    )


def model_scale(value, relation, transform, unit=None) -> Column:
    """Struct(value, lower, upper) on the identity, log10 or p-scale (bounds swap on the p-scale)."""
    v, r, t = as_col(value).cast("double"), as_col(relation), as_col(transform)
    # Molar factors accepted by the p-scale.
    molar = lookup(
        as_col(unit) if unit is not None else F.lit("M"),
        {"pM": 1e-12, "nM": 1e-9, "uM": 1e-6, "mM": 1e-3, "M": 1.0},
    )
    scaled = (
        F.when(t == "identity", v)
        .when(v <= 0, None)
        .when(t == "log10", F.log10(v))
        .when(t == "p", -F.log10(v * molar))
    )
    floor_side, cap_side = r.isin("=", "~", ">", ">="), r.isin("=", "~", "<", "<=")
    inverted = t == "p"
    return F.struct(
        scaled.alias("value"),
        F.when(F.when(inverted, cap_side).otherwise(floor_side), scaled).alias("lower"),
        F.when(F.when(inverted, floor_side).otherwise(cap_side), scaled).alias("upper"),
    )


def ladder(c, cuts, labels) -> Column:
    """First label whose right-closed cut is not exceeded; the last label is the rest."""
    x = as_col(c)
    out = F.when(x <= cuts[0], labels[0])
    for cut, label in zip(cuts[1:], labels[1:]):
        out = out.when(x <= cut, label)
    return out.otherwise(labels[len(cuts)])


def ramp(c, low: float, high: float) -> Column:
    """clip((x - low) / (high - low), 0, 1), NULL-preserving."""
    x = as_col(c)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low))))


def window_violations(windows: dict) -> Column:
    """Array of ``name:missing|below_min|above_max`` for each property outside its (low, high)."""
    parts = []
    for name, (low, high) in windows.items():
        x = as_col(name)
        state = F.when(x.isNull(), F.lit(f"{name}:missing"))
        if low is not None:
            state = state.when(x < low, F.lit(f"{name}:below_min"))
        if high is not None:
            state = state.when(x > high, F.lit(f"{name}:above_max"))
        parts.append(state)
    return F.array_compact(F.array(*parts))


def interval_label(lower, upper, positive_at: float, negative_at: float) -> Column:
    """Struct(label, basis): 1 when the whole interval is >= positive_at, 0 when <= negative_at."""
    lo, hi = as_col(lower), as_col(upper)
    pos, neg = lo >= positive_at, hi <= negative_at
    label = F.when(pos, F.lit(1)).when(neg, F.lit(0))
    basis = (
        F.when(lo.isNull() & hi.isNull(), "no_bounds")
        .when(F.coalesce(lo > hi, F.lit(False)), "empty_interval")
        .when(pos, "lower_bound_reaches_threshold")
        .when(neg, "upper_bound_below_threshold")
        .otherwise("interval_spans_threshold")
    )
    return F.struct(F.when(basis != "empty_interval", label).alias("label"), basis.alias("basis"))


def normal_cdf(z: Column) -> Column:
    """Standard normal CDF by the Abramowitz-Stegun 7.1.26 rational form (|error| < 1.5e-7)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = F.lit(0.0)
    # Published coefficients, highest power first.
    for a in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = (poly + F.lit(a)) * t
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    return F.lit(0.5) * (F.lit(1.0) + F.signum(z) * erf)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / F.lit((2 * 3.141592653589793) ** 0.5)
