"""Exact order statistics without putting a whole group, or the whole table, in one task.

Every operator that needs ranks goes through :func:`ranked_values`.  Rows are first counted per
(key, value); the value axis is then cut into ranges at approximate quantiles of the whole
column (a mergeable sketch, returned as at most ``RANGES`` numbers), counts per (key, range) give exact
offsets, and only values inside one (key, range) are sorted together.  A key holding a third of
all rows is spread over a third of the ranges.  The cut points affect balance, never the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join that keeps NULL keys equal; the right copies of the keys are dropped."""
    if not keys:
        raise ValueError("keys required")
    r = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys])
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def cut_points(df: DataFrame, value: str, ranges: int = RANGES, error: float = 0.005) -> list[float]:
    """Distinct approximate quantiles of a numeric column (bounded: at most ``ranges - 1``)."""
    probs = [i / ranges for i in range(1, ranges)]
    got = df.agg(F.percentile_approx(F.col(value), F.array(*map(F.lit, probs)), int(1 / error)).alias("q")).first()
    return sorted({float(x) for x in (got.q or [])})


def with_range(df: DataFrame, value: str, cuts, out: str) -> DataFrame:
    """Attach the index of the half-open range a double falls in (a binary search in the JVM)."""
    cuts = sorted({float(c) for c in cuts if abs(float(c)) < float("inf")})
    if not cuts:
        return df.withColumn(out, F.lit(0))
    edges = [float("-inf"), *cuts, float("inf")]
    b = Bucketizer(splits=edges, inputCol=value, outputCol=out, handleInvalid="keep")
    return b.transform(df).withColumn(out, F.col(out).cast("int"))


def rank_cells(cells: DataFrame, value: str, keys=(), weights=("n",), cuts=()) -> DataFrame:
    """Attach exact running totals to cells that are already unique per (keys, value).

    Each weight ``w`` is read from ``<w>_tied`` and yields ``<w>_before`` (total over smaller values
    of the same key) and ``<w>_group``.  Other columns are carried along.
    """
    keys, names = list(keys), list(weights)
    parted = with_range(cells, value, cuts, "__range")
    per_range = parted.groupBy(*keys, "__range").agg(
        *[F.sum(f"{n}_tied").alias(f"__{n}_in") for n in names]
    )
    order = Window.partitionBy(*keys).orderBy("__range")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_range.select(
        *keys,
        "__range",
        *[F.coalesce(F.sum(f"__{n}_in").over(before), F.lit(0)).alias(f"__{n}_off") for n in names],
        *[F.sum(f"__{n}_in").over(whole).alias(f"{n}_group") for n in names],
    )
    local = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = parted.withColumns(
        {f"__{n}_loc": F.coalesce(F.sum(f"{n}_tied").over(local), F.lit(0)) for n in names}
    )
    joined = null_safe_join(inside, offsets, [*keys, "__range"])
    return joined.withColumns(
        {f"{n}_before": F.col(f"__{n}_off") + F.col(f"__{n}_loc") for n in names}
    ).drop("__range", *[f"__{n}_loc" for n in names], *[f"__{n}_off" for n in names])


def ranked_values(
    df: DataFrame, value: str, keys=(), sums=(), ranges: int = RANGES, cuts=None
) -> DataFrame:
    """One row per (keys, value) among non-NULL values, ascending.

    Columns: keys, value, ``n_tied``, ``n_before`` (rows with a smaller value), ``n_group``; and for
    each column in ``sums``: ``<c>_tied``, ``<c>_before``, ``<c>_group``.
    """
    keys = list(keys)
    src = df.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double") + F.lit(0.0))
    counted = src.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n_tied"), *[F.sum(c).alias(f"{c}_tied") for c in sums]
    )
    cuts = cut_points(src, value, ranges) if cuts is None else cuts
    return rank_cells(counted, value, keys, ("n", *sums), cuts)


def quantile_of(value: str, p: float, kind: str = "linear") -> Column:
    """Aggregate over rank cells of one key: the exact p-quantile of ``value``."""
    pos = F.lit(float(p)) * (F.col("n_group") - 1)
    # guard floating noise such as 0.9 * 10 = 9.000000000000002
    pos = F.when(F.abs(pos - F.round(pos)) < 1e-9, F.round(pos)).otherwise(pos)
    last = F.col("n_before") + F.col("n_tied") - 1
    at_lo = F.max(F.when(F.floor(pos).between(F.col("n_before"), last), F.col(value)))
    at_hi = F.max(F.when(F.ceil(pos).between(F.col("n_before"), last), F.col(value)))
    if kind == "higher":
        return at_hi
    if kind == "lower":
        return at_lo
    return at_lo + (at_hi - at_lo) * F.max(pos - F.floor(pos))


def average_rank() -> Column:
    """1-based tie-averaged rank over the columns of :func:`ranked_values`."""
    return F.col("n_before") + (F.col("n_tied") + 1) / 2


def group_quantiles(df: DataFrame, value: str, probs: dict, keys=(), kind: str = "linear", cuts=None) -> DataFrame:
    """Exact quantiles per key: ``linear`` interpolation, or ``higher``/``lower`` order statistics."""
    keys = list(keys)
    ranked = ranked_values(df, value, keys, cuts=cuts)
    aggs = [quantile_of(value, p, kind).alias(name) for name, p in probs.items()]
    return ranked.groupBy(*keys).agg(*aggs) if keys else ranked.agg(*aggs)


def with_average_rank(df: DataFrame, value: str, out: str, keys=()) -> DataFrame:
    """Attach the tie-averaged rank of ``value`` within ``keys`` (NULL values rank NULL)."""
    keys = list(keys)
    ranks = ranked_values(df, value, keys).select(*keys, F.col(value).alias("__v"), average_rank().alias(out))
    base = df.withColumn("__v", F.col(value).cast("double") + F.lit(0.0))
    return null_safe_join(base, ranks, [*keys, "__v"], "left").drop("__v")


def hashed_index(df: DataFrame, key: str, out: str = "idx", hex_digits: int = 2) -> DataFrame:
    """Dense 0-based index over distinct keys in MD5 order, computed bucket by bucket."""
    h = df.select(key).distinct().withColumn("__h", F.md5(F.col(key).cast("string")))
    h = h.withColumn("__b", F.substring("__h", 1, hex_digits))
    sizes = h.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    # at most 16 ** hex_digits rows
    w = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("__b", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__o"))
    rn = F.row_number().over(Window.partitionBy("__b").orderBy("__h", F.col(key)))
    return h.withColumn("__rn", rn).join(F.broadcast(offs), "__b").select(
        key, (F.col("__o") + F.col("__rn") - 1).alias(out)
    )


def order_number(df: DataFrame, column: str) -> Column:
    """Order-preserving number for a tie column: itself, or the first six bytes of its text."""
    if dict(df.dtypes)[column] in ("string",):
        head = F.rpad(F.substring(F.hex(F.substring(F.col(column), 1, 6)), 1, 12), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    return F.col(column).cast("double")


def ordered_index(df: DataFrame, value: str, tie: str, out: str, total: str | None = None, keys=()) -> DataFrame:
    """Attach the 1-based position in ascending (value, tie) order, over the table or within ``keys``.

    Both axes are cut into ranges, so neither one sort nor one heavily repeated value is ever
    handled by a single task.  Rows with a NULL value are left out.
    """
    keys = list(keys)
    base = df.where(F.col(value).isNotNull()).withColumn("__v", F.col(value).cast("double") + F.lit(0.0))
    base = base.withColumn("__t", order_number(df, tie))
    probs = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    got = base.agg(F.percentile_approx("__v", probs, 200).alias("v"), F.percentile_approx("__t", probs, 200).alias("t")).first()
    vc, tc = sorted(set(got.v or [])), sorted(set(got.t or []))
    base = with_range(with_range(base, "__v", vc, "__rv"), "__t", tc, "__rt")
    cells = base.groupBy(*keys, "__rv", "__v", "__rt").agg(F.count(F.lit(1)).alias("__n"))
    per = cells.groupBy(*keys, "__rv").agg(F.sum("__n").alias("__m"))  # at most RANGES rows per key
    w = Window.partitionBy(*keys).orderBy("__rv")
    per = per.select(
        *keys,
        "__rv",
        F.coalesce(F.sum("__m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        F.sum("__m").over(Window.partitionBy(*keys)).alias("__all"),
    )
    local = Window.partitionBy(*keys, "__rv").orderBy("__v", "__rt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__loc", F.coalesce(F.sum("__n").over(local), F.lit(0))).drop("__n")
    cells = null_safe_join(cells, per, [*keys, "__rv"])
    rn = F.row_number().over(Window.partitionBy(*keys, "__rv", "__v", "__rt").orderBy(tie))
    got = null_safe_join(base.withColumn("__rn", rn), cells, [*keys, "__rv", "__v", "__rt"])
    got = got.withColumn(out, F.col("__off") + F.col("__loc") + F.col("__rn"))
    if total:
        got = got.withColumn(total, F.col("__all"))
    return got.drop("__v", "__t", "__rv", "__rt", "__rn", "__off", "__loc", "__all")


def benjamini_hochberg(df: DataFrame, p: str, out: str, family=()) -> DataFrame:
    """Attach BH q-values per family; NULL p stays NULL.

    q = min over p' >= p of p' * m / rank(p'), so a suffix minimum per range plus the minimum of
    later ranges gives the exact value without sorting a family in one task.
    """
    family = list(family)
    src = df.where(F.col(p).isNotNull())
    cuts = cut_points(src, p)
    r = ranked_values(src, p, family, cuts=cuts).withColumn(
        "__raw", F.col(p) * F.col("n_group") / (F.col("n_before") + F.col("n_tied"))
    )
    r = with_range(r, p, cuts, "__range")
    per = r.groupBy(*family, "__range").agg(F.min("__raw").alias("__m"))
    later = Window.partitionBy(*family).orderBy(F.col("__range").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    per = per.select(*family, "__range", F.min("__m").over(later).alias("__later"))
    local = Window.partitionBy(*family, "__range").orderBy(F.col(p).desc()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    q = null_safe_join(r.withColumn("__q", F.min("__raw").over(local)), per, [*family, "__range"])
    q = q.select(
        *family,
        F.col(p).alias("__v"),
        F.least(F.lit(1.0), F.col("__q"), F.coalesce(F.col("__later"), F.lit(1.0))).alias(out),
    )
    base = df.withColumn("__v", F.col(p).cast("double") + F.lit(0.0))
    return null_safe_join(base, q, [*family, "__v"], "left").drop("__v")


def equal_count_bins(df: DataFrame, value: str, tie: str, bins: int, out: str) -> DataFrame:
    """Equal-count bins 1..bins over the total order (value, tie), as a quantile cut of ranks."""
    r = ordered_index(df, value, tie, "__rk", total="__n")
    b = F.greatest(F.lit(1), F.ceil((F.col("__rk") - 1) * F.lit(bins) / (F.col("__n") - 1)))
    return r.withColumn(out, b.cast("int")).drop("__rk", "__n")


def total_order(df: DataFrame, score: str, tie: str, out: str, descending: bool = True) -> DataFrame:
    """1-based rank by score then tie, over the whole table."""
    signed = F.negate(F.col(score)) if descending else F.col(score)
    return ordered_index(df.withColumn("__s", signed), "__s", tie, out).drop("__s")
