"""Reproducible pseudo-random draws from MD5, identical on every engine that has MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_text(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def hash_int(*parts) -> Column:
    """Uniform integer in [0, 2**32) keyed by the parts."""
    return F.conv(F.substring(hash_text(*parts), 1, 8), 16, 10).cast("long")


def hash_unit(*parts) -> Column:
    """Uniform double in [0, 1) keyed by the parts."""
    return hash_int(*parts) / F.lit(4294967296.0)
