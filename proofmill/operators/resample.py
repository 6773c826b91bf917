"""Group bootstraps, sign flips and permutations with reproducible MD5 draws.

Bootstraps work on per-group sufficient statistics: rows are read once, and every group draws its own
weight in each replicate, so replicates are summed where the groups are and only totals move.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions.draws import hash_int, hash_text, hash_unit
from proofmill.operators.ranking import null_safe_join


def poisson_weight(*parts) -> Column:
    """A Poisson(1) number keyed by the parts: how often a group counts in a replicate, without looking at other groups."""
    u, below, chance, out = hash_unit(*parts), 0.0, math.exp(-1), F.lit(0)
    for k in range(1, 13):
        below += chance
        chance /= k
        out = out + (u >= below).cast("int")
    return out


def replicated(groups: DataFrame, group: str, replicates: int, seed: int) -> DataFrame:
    """Each row of ``groups`` once for each replicate, with its ``rep`` and ``weight``; sums over replicates combine where the rows are."""
    d = groups.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    return d.withColumn("weight", poisson_weight(F.lit(seed), F.col("rep"), F.col(group))).where("weight > 0")


def group_bootstrap(df: DataFrame, group: str, stats: dict, metrics: dict, *, replicates: int, seed: int) -> DataFrame:
    """Per-replicate metrics.

    ``stats``: name -> aggregate over a group's rows (must add up); ``metrics``: name -> expression
    over the replicate totals of those names.
    """
    g = df.where(F.col(group).isNotNull()).groupBy(group).agg(*[c.alias(n) for n, c in stats.items()])
    w = replicated(g, group, replicates, seed)
    tot = w.groupBy("rep").agg(*[F.sum(F.col("weight") * F.col(n)).alias(n) for n in stats])
    return tot.select("rep", *[c.alias(n) for n, c in metrics.items()])


def percentile_interval(reps: DataFrame, metrics, level: float = 0.95) -> DataFrame:
    """Percentile limits over replicates (their number is a parameter, not data)."""
    a = (1 - level) / 2
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics]))
    long = reps.select(rows.alias("x")).select("x.*").where(F.col("v").isNotNull())
    return long.groupBy("metric").agg(
        F.percentile("v", F.lit(a)).alias("lower"),
        F.percentile("v", F.lit(1 - a)).alias("upper"),
        F.count(F.lit(1)).alias("n_replicates"),
    )


def paired_bootstrap(df: DataFrame, group: str, delta: str, *, replicates: int, seed: int) -> DataFrame:
    """Mean paired effect with group-bootstrap limits and a group sign-flip p-value, one row."""
    g = df.where(F.col(delta).isNotNull()).groupBy(group).agg(
        F.sum(delta).alias("s"), F.count(F.lit(1)).alias("n")
    )
    point = g.agg((F.sum("s") / F.sum("n")).alias("effect"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))
    boot = replicated(g, group, replicates, seed).groupBy("rep").agg((F.sum(F.col("weight") * F.col("s")) / F.sum(F.col("weight") * F.col("n"))).alias("b"))
    ci = boot.agg(
        F.percentile("b", F.lit(0.025)).alias("lower"),
        F.percentile("b", F.lit(0.975)).alias("upper"),
        F.avg((F.col("b") > 0).cast("double")).alias("probability_positive"),
    )
    sign = F.when(hash_int(F.lit(f"flip{seed}"), F.col("rep"), F.col(group)) % 2 == 0, 1).otherwise(-1)
    flips = g.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    flips = flips.groupBy("rep").agg(F.abs(F.sum(sign * F.col("s"))).alias("f"), F.abs(F.sum("s")).alias("o"))
    p = flips.agg(((F.count_if(F.col("f") >= F.col("o") - 1e-9) + 1) / (F.count(F.lit(1)) + 1)).alias("sign_flip_p"))
    out = point.withColumn("__one", F.lit(1))
    for d in (ci, p):
        out = out.join(d.withColumn("__one", F.lit(1)), "__one")
    return out.drop("__one")


def hash_position(df: DataFrame, keys, hash_col: str, out: str) -> DataFrame:
    """1-based position by a binary hash within keys; a big group is split by the hash's first byte.

    Keys and byte are one struct, in which nulls are equal, so that the join with the offsets finds rows where the window left them.
    """
    keys = list(keys)
    d = df.withColumn("__k", F.struct(*keys, F.substring(hash_col, 1, 1).alias("__b"))).drop(*keys)
    sizes = d.groupBy("__k").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*[f"__k.{k}" for k in keys]).orderBy("__k.__b").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("__k", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__o"))
    d = d.withColumn("__rn", F.row_number().over(Window.partitionBy("__k").orderBy(hash_col))).drop(hash_col)
    d = d.join(offs, "__k").withColumn(out, F.col("__o") + F.col("__rn")).drop("__o", "__rn")
    return d.select(*[F.col(f"__k.{k}").alias(k) for k in keys], *[c for c in d.columns if c != "__k"])


def permuted(df: DataFrame, row_id: str, value: str, *, within=(), replicates: int, seed: int, carry=()) -> DataFrame:
    """(rep, within, row_id, carry, permuted value): values shuffled among rows of the same cell."""
    within = list(within)
    drawn = lambda *parts: F.unhex(hash_text(*parts))
    place = F.struct(*within, "__pos").alias("__at")
    base = df.select(*within, row_id, value, *carry)
    home = base.drop(value).withColumn("__h", drawn(F.lit(f"home{seed}"), F.col(row_id)))
    home = hash_position(home, within, "__h", "__pos").select(place, row_id, *carry)
    reps = base.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    reps = reps.select(*within, "rep", value, drawn(F.lit(seed), F.col("rep"), F.col(row_id)).alias("__h"))
    moved = hash_position(reps, [*within, "rep"], "__h", "__pos").select(place, "rep", F.col(value).alias(f"permuted_{value}"))
    return home.join(moved, "__at").select("rep", *[F.col(f"__at.{k}").alias(k) for k in within], row_id, *carry, f"permuted_{value}")


def permutation_correlation(df: DataFrame, row_id: str, x: str, y: str, *, within=(), replicates: int, seed: int) -> DataFrame:
    """Correlation after centring within cells, with a within-cell permutation p-value, one row."""
    within = list(within)
    if within:
        mean = df.groupBy(*within).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"))
        d = null_safe_join(df, mean, within).withColumns({"__x": F.col(x) - F.col("__mx"), "__y": F.col(y) - F.col("__my")})
    else:
        d = df.withColumns({"__x": F.col(x), "__y": F.col(y)})
    obs = d.agg(F.corr("__x", "__y").alias("observed"), F.count(F.lit(1)).alias("n"))
    perm = permuted(d, row_id, "__y", within=within, replicates=replicates, seed=seed, carry=("__x",))
    null = perm.groupBy("rep").agg(F.corr("__x", "permuted___y").alias("r"))
    j = null.withColumn("__one", F.lit(1)).join(obs.withColumn("__one", F.lit(1)), "__one")
    return j.groupBy("observed", "n").agg(
        ((F.count_if(F.abs("r") >= F.abs("observed") - 1e-12) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value")
    )


def leave_group_out_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    """Each row's out-of-group mean, from group sums and one-row totals."""
    g = df.groupBy(group).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    tot = g.agg(F.sum("__s").alias("s"), F.sum("__n").alias("n")).first()
    g = g.withColumn("group_out_mean", (F.lit(tot.s) - F.col("__s")) / (F.lit(tot.n) - F.col("__n")))
    return null_safe_join(df, g.select(group, "group_out_mean"), [group])
