"""Panels, quotas and samples picked by total orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.operators.ranking import group_quantiles
from proofmill.session import cut_lineage


def reason_panel(df: DataFrame, key: str, size_col: str, classes: dict, *, size: int) -> DataFrame:
    """One extreme row per class (first matching class), then the largest rows, up to ``size``.

    A class's extreme comes from ``min_by``; the fill is a bounded top-``size``, so nothing is sorted
    as a whole.  Rows without a size come last, and a key counts once however often it is repeated.
    """
    names = list(classes)
    chain = None
    for i, n in enumerate(names):
        chain = F.when(classes[n], i) if chain is None else chain.when(classes[n], i)
    d = df.withColumn("__c", chain)
    order = F.struct(F.col(size_col).isNull(), F.negate(F.col(size_col)), F.col(key))
    best = d.where(F.col("__c").isNotNull()).groupBy("__c").agg(F.min_by(F.struct(key, size_col), order).alias("b"))
    best = best.select(F.lit(0).alias("__t"), "__c", F.col(f"b.{key}").alias(key), F.col(f"b.{size_col}").alias(size_col))
    most = size + len(names)
    largest = lambda x: x.orderBy(F.desc_nulls_last(size_col), key).limit(most).select(key, size_col)
    fill = cut_lineage(largest(d))
    found = fill.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    if found[0] == most and found[1] < most:  # repeated keys took places
        fill = largest(d.groupBy(key).agg(F.max(size_col).alias(size_col)))
    fill = fill.select(F.lit(1).alias("__t"), F.lit(len(names)).alias("__c"), key, size_col)
    u = best.unionByName(fill)  # at most size + 2 * classes rows
    first = u.groupBy(key).agg(F.min(F.struct("__t", "__c", F.col(size_col).isNull().alias("none"), F.negate(size_col).alias("s"))).alias("k"))
    out = first.orderBy("k.__t", "k.__c", "k.none", "k.s", key).limit(size)
    label = F.element_at(F.array(*map(F.lit, [*names, "largest_error"])), F.col("k.__c") + 1)
    return out.select(key, label.alias("reason"))


def quantile_cells(df: DataFrame, train: DataFrame, columns, probs, out: str) -> DataFrame:
    """Cell label from how many training quantiles each covariate reaches."""
    parts = []
    for c in columns:
        q = group_quantiles(train, c, {f"q{i}": p for i, p in enumerate(probs)}).first()
        n = reduce(lambda a, b: a + b, [F.when(F.col(c) >= float(e), 1).otherwise(0) for e in q])
        parts.append(n.cast("string"))
    return df.withColumn(out, F.concat_ws("_", *parts))


def quota_plan(df: DataFrame, key: str, series: str, categories, *, per_series: int) -> tuple[DataFrame, DataFrame]:
    """Fill categories in order; every pick uses up one place of its series.

    ``categories``: (name, condition, order columns, quota).  A category first removes chosen keys, then
    keeps the best rows that fit the series' remaining places (a per-series rank, limited before
    the shuffle), then its quota.  Chosen rows never exceed the sum of quotas.
    """
    chosen = None
    for i, (name, condition, order, quota) in enumerate(categories):
        pool = df.where(condition)
        if chosen is not None:
            pool = pool.join(F.broadcast(chosen.select(key)), key, "left_anti")
            used = chosen.groupBy(series).agg(F.count(F.lit(1)).alias("__used"))
            pool = pool.join(F.broadcast(used), series, "left")
        else:
            pool = pool.withColumn("__used", F.lit(0))
        rn = F.row_number().over(Window.partitionBy(series).orderBy(*order))
        pool = pool.withColumn("__rn", rn).where(F.col("__rn") <= per_series)
        pool = pool.where(F.col("__rn") + F.coalesce("__used", F.lit(0)) <= per_series)
        pick = pool.orderBy(*order).limit(quota)
        pick = pick.select(key, series, F.lit(name).alias("category"), F.lit(i).alias("category_order"))
        chosen = cut_lineage(pick if chosen is None else chosen.unionByName(pick))
    counts = chosen.groupBy("category").agg(F.count(F.lit(1)).alias("selected"))
    spark = df.sparkSession
    want = spark.createDataFrame([(n, q) for n, _, _, q in categories], "category string, quota long")
    summary = want.join(counts, "category", "left").select(
        "category", "quota", F.coalesce("selected", F.lit(0)).alias("selected"), (F.col("quota") - F.coalesce("selected", F.lit(0))).alias("shortfall")
    )
    return chosen, summary
