"""Leakage-free group and time splits, folds and balancing weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions.draws import hash_unit
from proofmill.functions.text import blank_to_null
from proofmill.operators.ranking import null_safe_join, ordered_index


def resolve_group(columns, row_key: str) -> Column:
    """First usable identity column; rows without any stay in a group of their own."""
    return F.coalesce(*[blank_to_null(c) for c in columns], F.concat(F.lit("missing:"), F.col(row_key)))


def candidate_holdouts(df: DataFrame, group: str, label: str, *, test_size: float, candidates: int, seed: int) -> DataFrame:
    """Score hash-threshold group holdouts by size and label balance, one row per candidate.

    Each candidate draws whole groups with probability ``test_size``; scoring needs two sums per
    candidate over the group table.
    """
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("s"))
    c = g.withColumn("candidate", F.explode(F.sequence(F.lit(1), F.lit(candidates))))
    test = hash_unit(F.lit(seed), F.col("candidate"), F.col(group)) < test_size
    t = c.groupBy("candidate").agg(
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias("n_test"),
        F.sum(F.when(test, F.col("s"))).alias("s_test"),
    )
    size_gap = F.abs(F.col("n_test") / F.col("n") - test_size)
    label_gap = F.abs(F.col("s_test") / F.col("n_test") - F.col("s") / F.col("n"))
    usable = (F.col("n_test") > 0) & (F.col("n_test") < F.col("n"))
    return t.where(usable).withColumn("score", size_gap + 0.35 * label_gap)


def group_holdout(df: DataFrame, group: str, label: str, *, test_size: float = 0.2, candidates: int = 24, seed: int = 13) -> DataFrame:
    """Attach ``role`` train/test from the best-scoring candidate; groups never straddle."""
    s = candidate_holdouts(df, group, label, test_size=test_size, candidates=candidates, seed=seed)
    best = s.agg(F.min(F.struct(F.round("score", 12).alias("s"), "candidate")).alias("b")).first().b
    if best is None:
        raise ValueError("could not construct a non-empty group holdout")
    test = hash_unit(F.lit(seed), F.lit(best.candidate), F.col(group)) < test_size
    return df.withColumn("role", F.when(test, "test").otherwise("train"))


def temporal_cutoffs(df: DataFrame, group: str, year: str, *, test_size: float = 0.2) -> DataFrame:
    """Viable cutoff years with test share and score; a group's year is its first."""
    g = df.groupBy(group).agg(F.min(year).alias("first_year"), F.count(F.lit(1)).alias("n"))
    y = g.groupBy("first_year").agg(F.sum("n").alias("n"))
    tot = F.sum("n").over(Window.partitionBy())
    later = F.sum(F.when(F.col("first_year").isNotNull(), F.col("n"))).over(
        Window.orderBy(F.col("first_year").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    )
    first = F.min("first_year").over(Window.partitionBy())
    # one row per calendar year, so these unpartitioned windows stay small
    c = y.select("first_year", later.alias("n_test"), tot.alias("n"), first.alias("__f"))
    need = F.greatest(F.lit(2), F.ceil(F.col("n") * test_size * 0.5))
    ok = F.col("first_year").isNotNull() & (F.col("first_year") > F.col("__f"))
    ok = ok & (F.col("n_test") >= need) & (F.col("n") - F.col("n_test") >= 2)
    return c.where(ok).select(
        F.col("first_year").alias("cutoff"), "n_test", "n", F.abs(F.col("n_test") / F.col("n") - test_size).alias("score")
    )


def temporal_holdout(df: DataFrame, group: str, year: str, *, test_size: float = 0.2) -> DataFrame:
    """Latest first-years become test; ties prefer the later cutoff; undated rows train."""
    c = temporal_cutoffs(df, group, year, test_size=test_size)
    best = c.agg(F.min(F.struct(F.round("score", 12).alias("s"), F.negate("cutoff").alias("c"))).alias("b")).first().b
    if best is None:
        raise ValueError("no viable temporal cutoff")
    g = df.groupBy(group).agg(F.min(year).alias("__fy"))
    out = null_safe_join(df, g, [group])
    test = F.coalesce(F.col("__fy") >= F.lit(-best.c), F.lit(False))
    return out.withColumn("role", F.when(test, "test").otherwise("train")).drop("__fy")


def split_audit(df: DataFrame, group: str, role: str = "role") -> DataFrame:
    """Rows and groups per role, and groups present on both sides (must be zero)."""
    g = df.groupBy(group).agg(
        F.count_if(F.col(role) == "train").alias("tr"), F.count_if(F.col(role) == "test").alias("te")
    )
    return g.agg(
        F.sum("tr").alias("n_train"),
        F.sum("te").alias("n_test"),
        F.count_if(F.col("tr") > 0).alias("train_groups"),
        F.count_if(F.col("te") > 0).alias("test_groups"),
        F.count_if((F.col("tr") > 0) & (F.col("te") > 0)).alias("overlapping_groups"),
    )


def table_digest(df: DataFrame, columns) -> DataFrame:
    """Order-free digest: count plus four sums of 32-bit words of row hashes, exact to 38 digits."""
    h = F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    d = df.select(h.alias("h"))
    parts = []
    for i in range(4):
        v = F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")
        parts.append(F.sum(v).cast("string").alias(f"s{i}"))
    return d.agg(F.count(F.lit(1)).alias("n_rows"), *parts).select(
        "n_rows", F.sha2(F.concat_ws(":", F.col("n_rows"), *[F.col(f"s{i}") for i in range(4)]), 256).alias("digest")
    )


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, n, fold): groups dealt out by falling size in snake order."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    r = ordered_index(g.withColumn("__s", F.negate("n")), "__s", group, "__pos").drop("__s")
    turn = (F.col("__pos") - 1) % (2 * folds)
    fold = F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn)
    return r.select(group, "n", fold.cast("int").alias("fold"))


def time_folds(df: DataFrame, group: str, year: str, splits: int) -> DataFrame:
    """(group, block): groups in first-year order cut into splits + 1 equal blocks.

    Fold k trains on blocks < k and tests on block k, for k = 1..splits.
    """
    g = df.groupBy(group).agg(F.min(year).alias("__y"))
    r = ordered_index(g.withColumn("__y", F.coalesce("__y", F.lit(0))), "__y", group, "__pos", total="__n")
    size = F.floor(F.col("__n") / (splits + 1))
    head = F.col("__n") - size * splits
    block = F.when(F.col("__pos") <= head, 0).otherwise(F.floor((F.col("__pos") - head - 1) / size) + 1)
    return r.select(group, block.cast("int").alias("block"))


def learning_subsets(df: DataFrame, group: str, fractions, repeats: int, seed: int) -> DataFrame:
    """(fraction, repeat, rows): nested random group subsets by hash threshold."""
    grid = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.lit(r).alias("repeat")) for f in fractions for r in range(repeats)])
    d = df.withColumn("g", F.explode(grid)).select("*", "g.fraction", "g.repeat").drop("g")
    return d.where(hash_unit(F.lit(seed), F.col("repeat"), F.col(group)) < F.col("fraction"))


def balanced_weights(df: DataFrame, keys, out: str = "weight") -> DataFrame:
    """Weight 1/count within keys, rescaled to mean one."""
    keys = list(keys)
    c = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"))
    t = c.agg(F.sum("__c").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return null_safe_join(df, c, keys).withColumn(out, F.lit(t.n) / (F.lit(t.k) * F.col("__c"))).drop("__c")


def regime_pool(internal: DataFrame, external: DataFrame, key: str, test_groups: DataFrame, group: str) -> DataFrame:
    """Training pool: both sources, minus test groups, external rows never repeating internal keys."""
    ext = external.join(internal.select(key).distinct(), key, "left_anti")
    pool = internal.withColumn("origin", F.lit("internal")).unionByName(
        ext.withColumn("origin", F.lit("external")), allowMissingColumns=True
    )
    return pool.join(test_groups.select(group).distinct(), group, "left_anti")


def source_mass(pool: DataFrame, origin: str, inner, out: str = "weight") -> DataFrame:
    """Half of all weight to the ``inner`` origins and half to the others, 1 on average; alone, a side weighs 1 a row."""
    own = F.col(origin).isin(*inner)
    t = pool.agg(F.count(F.lit(1)).alias("n"), F.count_if(own).alias("a")).first()
    if not t.a or t.a == t.n:
        return pool.withColumn(out, F.lit(1.0))
    return pool.withColumn(out, F.when(own, t.n / (2.0 * t.a)).otherwise(t.n / (2.0 * (t.n - t.a))))


#: Training regimes: which tables they join, whether external rows are limited, whether the sources' masses are balanced.
REGIMES = {
    "internal_only": ((), None, False),
    "plus_extension": (("extension",), None, False),
    "plus_external_naive": (("external",), "all", False),
    "plus_external_balanced": (("external",), "all", True),
    "plus_external_large": (("external",), "large", True),
    "plus_extension_and_external_balanced": (("extension", "external"), "all", True),
}


def regime_pools(internal: DataFrame, extension: DataFrame, external: DataFrame, key: str, group: str, test_groups: DataFrame, large) -> DataFrame:
    """(regime, origin, weight, columns of ``internal``): the training rows of every regime.

    No row belongs to a test group; external rows never repeat an internal key; ``large`` is the condition of the
    regime that only takes such external rows.  Internal rows and their extension balance the external ones.
    """
    out = None
    parts = {"extension": extension, "external": external.join(internal.select(key).distinct(), key, "left_anti")}
    for regime, (names, which, balanced) in REGIMES.items():
        pool = internal.withColumn("origin", F.lit("internal"))
        for n in names:
            part = parts[n].where(large) if n == "external" and which == "large" else parts[n]
            pool = pool.unionByName(part.select(*internal.columns).withColumn("origin", F.lit(n)))
        pool = pool.join(test_groups.select(group).distinct(), group, "left_anti")
        pool = source_mass(pool, "origin", ("internal", "extension")) if balanced else pool.withColumn("weight", F.lit(1.0))
        pool = pool.select(F.lit(regime).alias("regime"), "origin", "weight", *internal.columns)
        out = pool if out is None else out.unionByName(pool)
    return out
