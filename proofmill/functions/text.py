"""Text cleaning, identifiers and delimited sets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c) -> Column:
    """Trimmed text; NULL becomes the empty string."""
    return F.coalesce(F.trim(as_col(c).cast("string")), F.lit(""))


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(as_col(c).cast("string")), F.lit(""))


def optional_bool(c) -> Column:
    """Tri-state boolean from true/1/yes/y and false/0/no/n; anything else is NULL."""
    t = F.lower(clean(c))
    return F.when(t.isin("true", "1", "yes", "y"), F.lit(True)).when(
        t.isin("false", "0", "no", "n"), F.lit(False)
    )


def strict_bool(c) -> Column:
    """False unless the text says true, 1, yes or y."""
    return F.coalesce(optional_bool(c), F.lit(False))


def stable_id(prefix: str, parts, length: int = 20) -> Column:
    """``prefix-`` plus the upper-case head of SHA-256 over NUL-joined parts (NULL counts as '')."""
    text = F.concat_ws("\0", *[clean(p) for p in parts])
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.sha2(text, 256), 1, length)))


def join_flags(flags: Column) -> Column:
    """Sorted, distinct, ``;``-joined text of an array of flags (NULLs dropped)."""
    return F.concat_ws(";", F.array_sort(F.array_distinct(F.array_compact(flags))))


def join_set(c) -> Column:
    """Aggregate: sorted distinct non-blank values, ``;``-joined.

    Meant for columns with a fixed vocabulary (sources, relations, endpoints).  For open
    vocabularies use :func:`proofmill.operators.aggregate.joined_uniques`.
    """
    return F.concat_ws(";", F.array_sort(F.collect_set(blank_to_null(c))))


def split_trim(c, pattern: str) -> Column:
    return F.transform(F.split(clean(c), pattern), lambda x: F.trim(x))


def extract_year(c) -> Column:
    """Earliest plausible 19xx/20xx in free text, else a bare number in 1900..2100."""
    text = clean(c)
    found = F.transform(
        F.regexp_extract_all(text, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1)),
        lambda x: x.cast("int"),
    )
    bare = text.try_cast("double")
    return F.coalesce(
        F.array_min(found), F.when(bare.between(1900, 2100), F.floor(bare).cast("int"))
    )


def year_band(year, width: int = 5) -> Column:
    y = as_col(year)
    start = (F.floor(y / width) * width).cast("long")
    return F.when(y.isNull(), F.lit("undated")).otherwise(
        F.concat(start.cast("string"), F.lit("-"), (start + width - 1).cast("string"))
    )
