"""Projections of source tables onto the common measurement schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions.text import blank_to_null
from proofmill.functions.values import parse_numeric


def ensure_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Add absent columns with their defaults."""
    new = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(new) if new else df


def project(df: DataFrame, mapping: dict, default: str = "") -> DataFrame:
    """Select target columns from names, expressions or, when the name is absent, the default."""
    cols = []
    for target, src in mapping.items():
        if isinstance(src, Column):
            cols.append(src.alias(target))
        elif src in df.columns:
            cols.append(F.col(src).alias(target))
        else:
            cols.append(F.lit(default).alias(target))
    return df.select(*cols)


def first_available(df: DataFrame, candidates) -> DataFrame:
    """Adds value, unit and origin from the first (value, unit, origin) whose value is numeric."""
    picks = [
        F.when(parse_numeric(v).isNotNull(), F.struct(parse_numeric(v).alias("value"), u.alias("unit"), F.lit(o).alias("origin")))
        for v, u, o in candidates
    ]
    return df.withColumn("__p", F.coalesce(*picks)).withColumns(
        {"value": F.col("__p.value"), "unit": F.col("__p.unit"), "origin": F.col("__p.origin")}
    ).drop("__p")


def override(current: Column, reviewed: Column) -> Column:
    """A non-blank reviewed value replaces the current one."""
    return F.coalesce(F.nullif(F.trim(reviewed), F.lit("")), current)


def melt(df: DataFrame, ids, columns, name: str = "endpoint", value: str = "value_text") -> DataFrame:
    """Wide to long, blanks dropped."""
    d = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns])
    return d.unpivot(list(ids), list(columns), name, value).where(blank_to_null(value).isNotNull())


def enrich_from_catalog(df: DataFrame, catalog: DataFrame, key: str, order: str) -> DataFrame:
    """Left join with one catalogue row per key, the first by ``order``."""
    rest = [c for c in catalog.columns if c != key]
    one = catalog.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("c")).select(key, "c.*")
    return df.join(one, key, "left")
