"""Panels under constraints: mandatory rows, whole pairs, strata, series limits, then the most informative or most distant rows.

A panel is a handful of rows, so its picks are made one after another: every pick is one scan of the table that
scores all rows against the picks so far, combines map-side and returns one row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _vectors(v: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(r, float) for r in v]) if len(v) else np.zeros((0, 1))


def distance_to(points: np.ndarray, vec: str) -> Column:
    """Least Euclidean distance to the given points."""

    @F.pandas_udf("double")
    def least(v: pd.Series) -> pd.Series:
        x = _vectors(v)
        best = np.full(len(x), np.inf)
        for p in points:
            best = np.minimum(best, np.sqrt(((x - p) ** 2).sum(1)))
        return pd.Series(best)

    return least(F.col(vec))


def information_of(inverse: np.ndarray, vec: str) -> Column:
    """log(1 + x' A^-1 x): what a row adds to the logarithm of the determinant of A."""

    @F.pandas_udf("double")
    def gain(v: pd.Series) -> pd.Series:
        x = _vectors(v)
        return pd.Series(np.log1p(np.einsum("ij,jk,ik->i", x, inverse, x)))

    return gain(F.col(vec))


def disjoint_pairs(pairs: DataFrame, a: str, b: str, order, used, most: int, condition=None) -> list:
    """The best pairs one after another, each id at most once and none of ``used``; ``condition`` (of the picks so far) limits them further."""
    ids, out = set(used), []
    by = F.struct(*order)
    while len(out) < most:
        pool = pairs.where(~F.col(a).isin(*ids) & ~F.col(b).isin(*ids)) if ids else pairs
        if condition is not None:
            pool = pool.where(condition(out))
        best = pool.agg(F.min_by(F.struct(*pairs.columns), by).alias("p")).first().p
        if best is None:
            break
        out.append(best)
        ids |= {best[a], best[b]}
    return out


def constrained_panel(df: DataFrame, key: str, vec: str, size: int, *, goal: str = "distance", mandatory=(), pairs: DataFrame | None = None, pair_columns=("id_a", "id_b"), pair_order=(), pair_slots: int = 0, strata=(), series: str | None = None, per_series: int = 1, ridge: float = 1.0) -> DataFrame:
    """(key, place, reason): a panel of at most ``size`` rows.

    First the mandatory rows, then the best disjoint pairs within ``pair_slots`` places, whole; then, for each column of
    ``strata`` and each of its values that no row has yet, the row farthest from those chosen; then rows by ``goal``,
    ``distance`` or ``information``, of series that hold fewer than ``per_series`` chosen rows, or of any series once none is
    left.  Ties go to the smallest key.  Without any row chosen, distances are from the origin.
    """
    if goal not in ("distance", "information"):
        raise ValueError(f"unknown goal {goal!r}")
    extra = list(dict.fromkeys([*strata, *([series] if series else [])]))
    rows = df.select(key, F.col(vec).cast("array<double>").alias("vec"), *extra).where(F.col("vec").isNotNull())
    first = rows.select(F.size("vec").alias("d")).first()
    spark = df.sparkSession
    kind = f"`{key}` {df.schema[key].dataType.simpleString()}, place int, reason string"
    if first is None:
        return spark.createDataFrame([], kind)
    chosen: list = []
    reasons: list[str] = []

    def add(row, reason):
        chosen.append(row)
        reasons.append(reason)

    def best(pool, score):
        b = pool.agg(F.min_by(F.struct(*rows.columns), F.struct(F.negate(F.round(score, 9)), F.col(key))).alias("b")).first()
        return b.b

    def free():
        return rows.where(~F.col(key).isin(*[r[key] for r in chosen])) if chosen else rows

    def apart():
        return distance_to(np.array([r["vec"] for r in chosen]) if chosen else np.zeros((1, first.d)), "vec")

    wanted = {r[key]: r for r in rows.where(F.col(key).isin(*mandatory)).collect()} if mandatory else {}
    for k in mandatory:
        if k in wanted and len(chosen) < size:
            add(wanted.pop(k), "mandatory")
    if pairs is not None:
        a, b = pair_columns
        most = min(pair_slots, size - len(chosen)) // 2
        for n, p in enumerate(disjoint_pairs(pairs, a, b, pair_order, [r[key] for r in chosen], most), 1):
            got = {r[key]: r for r in rows.where(F.col(key).isin(p[a], p[b])).collect()}
            if len(got) == 2:
                for side in (a, b):
                    add(got[p[side]], f"pair {n}")
    for column in strata:
        have = {str(r[column]) for r in chosen if r[column] is not None}
        values = [r[0] for r in rows.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct().orderBy(F.col(column).cast("string")).limit(size + len(have)).collect()]
        for v in values:
            if v in have or len(chosen) >= size:
                continue
            got = best(free().where(F.col(column).cast("string") == v), apart())
            if got is not None:
                add(got, f"{column} {v}")
                have.add(v)
    while len(chosen) < size:
        if goal == "distance":
            score = apart()
        else:
            x = np.array([r["vec"] for r in chosen]).reshape(len(chosen), first.d)
            score = information_of(np.linalg.inv(ridge * np.eye(first.d) + x.T @ x), "vec")
        pool = free()
        got = None
        if series:
            held = [r[series] for r in chosen if r[series] is not None]
            full = sorted({s for s in held if held.count(s) >= per_series}, key=str)
            got = best(pool.where(F.col(series).isNull() | ~F.col(series).isin(*full)) if full else pool, score)
        if got is None:
            got = best(pool, score)
        if got is None:
            break
        add(got, goal)
    return spark.createDataFrame([(r[key], i, reason) for i, (r, reason) in enumerate(zip(chosen, reasons), 1)], kind)


def mixed_quotas(df: DataFrame, key: str, series: str, categories, *, per_series: int) -> DataFrame:
    """(key, category, place, pair): quotas filled in order, where single rows and whole pairs use up the same places of a series.

    ``categories``: dicts with name, quota, order and either ``where`` (single rows) or ``pairs`` (a table of id_a, id_b, series_a,
    series_b and the order's columns).  A pair is taken only whole: both rows free, a place in each series (two where they share one),
    and two places left in the quota.
    """
    out: list = []  # key, category, place, pair
    used: dict = {}

    def take(k, s, name, pair):
        out.append((k, name, len(out) + 1, pair))
        used[s] = used.get(s, 0) + 1

    def left(column):
        """Places left in the series of ``column``; a null series is one of its own."""
        chain = reduce(lambda c, kv: c.when(F.col(column).eqNullSafe(F.lit(kv[0])), per_series - kv[1]), used.items(), F.when(F.lit(False), 0))
        return chain.otherwise(per_series)

    for c in categories:
        ids = [k for k, *_ in out]
        if "pairs" in c:
            n = 0

            def condition(picks):
                nonlocal n
                for p in picks[n:]:  # those accepted since the last look
                    take(p["id_a"], p["series_a"], c["name"], f"{c['name']} {n + 1}")
                    take(p["id_b"], p["series_b"], c["name"], f"{c['name']} {n + 1}")
                    n += 1
                same = F.col("series_a").eqNullSafe(F.col("series_b"))
                return (left("series_a") >= F.when(same, 2).otherwise(1)) & (left("series_b") >= 1)

            picks = disjoint_pairs(c["pairs"], "id_a", "id_b", c["order"], ids, c["quota"] // 2, condition)
            condition(picks)
            continue
        pool = df.where(c["where"])
        pool = pool.where(~F.col(key).isin(*ids)) if ids else pool
        nth = F.row_number().over(Window.partitionBy(series).orderBy(*c["order"]))
        pool = pool.withColumn("__nth", nth).where(F.col("__nth") <= per_series).where(F.col("__nth") <= left(series))
        for r in pool.orderBy(*c["order"]).limit(c["quota"]).select(key, series).collect():
            take(r[key], r[series], c["name"], None)
    kind = f"`{key}` {df.schema[key].dataType.simpleString()}, category string, place int, pair string"
    return df.sparkSession.createDataFrame(out, kind)
