"""Audited holdouts with a recorded fallback, stratified group folds, and leave-one-group-out baselines."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.functions.draws import hash_unit
from proofmill.operators.models import ridge
from proofmill.operators.ranking import null_safe_join, ordered_index
from proofmill.operators.splits import split_audit, table_digest

#: Added to the score of a holdout that misses a class on one side.
MISSING_CLASS = 10.0


@dataclass
class SplitRecord:
    """What was asked for and what was done."""

    requested: str
    strategy: str
    fallback_reason: str | None
    cutoff: int | None
    score: float
    n_rows: int
    n_train: int
    n_test: int
    identity_overlap: int
    digest: str


def _class_gaps(cells: DataFrame, by: str, classify: bool, weight: float) -> DataFrame:
    """Score of each holdout in ``by`` from cells (by, label, n, n_test): share of test rows, missing classes, shift of the label."""
    y = F.col("label").cast("double")
    t = cells.groupBy(by).agg(
        F.sum("n").alias("n"),
        F.sum("n_test").alias("n_test"),
        F.sum(F.col("n") * y).alias("s"),
        F.sum(F.col("n") * y * y).alias("ss"),
        F.sum(F.col("n_test") * y).alias("s_test"),
        F.count_if((F.col("n_test") == 0) | (F.col("n_test") == F.col("n"))).alias("one_sided"),
    )
    shift = F.coalesce(F.abs(F.col("s_test") / F.col("n_test") - F.col("s") / F.col("n")), F.lit(0.0))
    if classify:
        label = F.when(F.col("one_sided") > 0, MISSING_CLASS).otherwise(weight * shift)
    else:
        deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)))
        label = weight * shift / F.when(deviation > 0, deviation).otherwise(1.0)
    return t, label


def _group_roles(df: DataFrame, unit: str, label: str | None, classify: bool, test_size: float, candidates: int, seed: int, weight: float):
    """(units with role, score): the best of ``candidates`` draws of whole units; each draw needs two counts a class."""
    y = F.col(label) if label else F.lit(0)
    cells = df.groupBy(unit, y.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    if df.select(unit).distinct().limit(2).count() < 2:
        raise ValueError("a group holdout needs two groups")
    drawn = cells.withColumn("candidate", F.explode(F.sequence(F.lit(1), F.lit(candidates))))
    test = hash_unit(F.lit(seed), F.col("candidate"), F.col(unit)) < test_size
    drawn = drawn.groupBy("candidate", "label").agg(F.sum("n").alias("n"), F.sum(F.when(test, F.col("n")).otherwise(0)).alias("n_test"))
    t, gap = _class_gaps(drawn, "candidate", classify and label is not None, weight)
    usable = t.where((F.col("n_test") > 0) & (F.col("n_test") < F.col("n")))
    score = F.round(F.abs(F.col("n_test") / F.col("n") - test_size) + gap, 12)
    best = usable.agg(F.min(F.struct(score.alias("score"), "candidate")).alias("b")).first().b
    if best is None:
        raise ValueError("no draw leaves rows on both sides")
    chosen = hash_unit(F.lit(seed), F.lit(best.candidate), F.col(unit)) < test_size
    return df.withColumn("role", F.when(chosen, "test").otherwise("train")), best.score, None


def _time_roles(df: DataFrame, identity: str, year: str | None, label: str | None, classify: bool, test_size: float, least_dated: float):
    """Identities by their first year; the latest become test, undated ones train."""
    if year is None or year not in df.columns:
        raise ValueError("no time column")
    first = df.groupBy(identity).agg(F.min(year).alias("__first"))
    rows = null_safe_join(df, first, [identity])
    y = F.col(label) if label else F.lit(0)
    cells = rows.groupBy("__first", y.alias("label")).agg(F.count(F.lit(1)).alias("n"))  # calendar years times classes
    n, dated, years = cells.agg(F.sum("n"), F.sum(F.when(F.col("__first").isNotNull(), F.col("n"))), F.count_distinct("__first")).first()
    if (dated or 0) < max(4, -int(-least_dated * n // 1)):
        raise ValueError("too few dated rows")
    if years < 2:
        raise ValueError("two years are needed")
    first_years = sorted(r[0] for r in cells.where("__first is not null").select("__first").distinct().limit(4001).collect())
    if len(first_years) > 4000:
        raise ValueError("more years than a calendar has")
    each = cells.withColumn("cutoff", F.explode(F.array(*map(F.lit, first_years[1:]))))
    tested = F.coalesce(F.col("__first") >= F.col("cutoff"), F.lit(False))
    each = each.groupBy("cutoff", "label").agg(F.sum("n").alias("n"), F.sum(F.when(tested, F.col("n")).otherwise(0)).alias("n_test"))
    t, _ = _class_gaps(each, "cutoff", classify and label is not None, 0.0)
    missing = F.when(F.col("one_sided") > 0, MISSING_CLASS).otherwise(0.0) if classify and label else F.lit(0.0)
    viable = t.where((F.col("n_test") >= F.greatest(F.lit(2), F.ceil(F.col("n") * test_size * 0.5))) & (F.col("n") - F.col("n_test") >= 2))
    score = F.round(F.abs(F.col("n_test") / F.col("n") - test_size) + missing, 12)
    best = viable.agg(F.min(F.struct(score.alias("score"), F.negate("cutoff").alias("late"))).alias("b")).first().b
    if best is None:
        raise ValueError("no viable cutoff")
    test = F.coalesce(F.col("__first") >= -best.late, F.lit(False))
    return rows.withColumn("role", F.when(test, "test").otherwise("train")).drop("__first"), best.score, -best.late


def split_plan(df: DataFrame, strategy: str, identity: str, *, group: str | None = None, label: str | None = None, year: str | None = None, classify: bool = True, test_size: float = 0.2, candidates: int = 24, seed: int = 13, label_weight: float = 0.35, least_dated: float = 0.5) -> tuple[DataFrame, SplitRecord]:
    """(rows with ``role``, record) of a holdout that keeps every identity on one side.

    ``random`` draws identities, ``group`` draws groups (an identity belongs to its smallest one), ``temporal`` takes
    the identities that appear last.  Where the strategy cannot be carried out, identities are drawn instead and
    the reason is recorded.
    """
    if strategy not in ("random", "group", "temporal"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if not 0.05 <= test_size <= 0.5:
        raise ValueError("test_size lies between 0.05 and 0.5")
    if df.limit(4).count() < 4:
        raise ValueError("four rows are needed")
    reason = None
    random = lambda: _group_roles(df, identity, label, classify, test_size, candidates, seed, label_weight)
    used = strategy
    try:
        if strategy == "random":
            out, score, cutoff = random()
        elif strategy == "temporal":
            out, score, cutoff = _time_roles(df, identity, year, label, classify, test_size, least_dated)
        else:
            if group is None:
                raise ValueError("no group column")
            unit = df.groupBy(identity).agg(F.min(group).alias("__unit"))
            out, score, cutoff = _group_roles(null_safe_join(df, unit, [identity]), "__unit", label, classify, test_size, candidates, seed, label_weight)
            out = out.drop("__unit")
    except ValueError as e:
        used, reason = "random", str(e)
        out, score, cutoff = random()
    a = split_audit(out, identity).first()
    digest = table_digest(out, [identity, *([label] if label else []), "role"]).first().digest
    return out, SplitRecord(strategy, used, reason, cutoff, float(score), a.n_train + a.n_test, a.n_train, a.n_test, a.overlapping_groups, digest)


def record_table(spark, records) -> DataFrame:
    kinds = "requested string, strategy string, fallback_reason string, cutoff long, score double, n_rows long, n_train long, n_test long, identity_overlap long, digest string"
    return spark.createDataFrame([tuple(asdict(r).values()) for r in records], kinds)


def stratified_folds(df: DataFrame, group: str, label: str, folds: int, classes: int = 64) -> tuple[DataFrame, dict]:
    """(group, n, fold) and a record: groups dealt so that every fold gets its share of every class.

    Groups are ordered by their counts of the rarest class, then of the next, and dealt in snake order.  The number of
    folds falls to that of the rarest class's rows and of the groups; where a class is still missing from some fold it falls
    further, and with fewer than two folds the table cannot be split.  ``classes`` bounds the label's distinct values.
    """
    cells = df.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    totals = [(r[label], r["n"]) for r in cells.groupBy(label).agg(F.sum("n").alias("n")).orderBy("n", label).limit(classes + 1).collect()]
    if len(totals) > classes:
        raise ValueError(f"more than {classes} classes")
    if not totals:
        raise ValueError("no labelled rows")
    counts = [F.coalesce(F.sum(F.when(F.col(label) == v, F.col("n"))), F.lit(0)).alias(f"c{i}") for i, (v, _) in enumerate(totals)]
    per = cells.groupBy(group).agg(F.sum("n").alias("n"), *counts)
    names = [f"c{i}" for i in range(len(totals))]
    most = [int(v) + 1 for v in per.agg(*[F.max(c) for c in names]).first()]
    # the counts as digits of one number, exact while the product stays below 2**53; beyond it the ties' text keeps the order
    size = F.lit(0.0)
    for c, m in zip(names, most):
        size = size * float(m) + F.col(c)
    tie = F.concat_ws(":", *[F.lpad((F.lit(m) - F.col(c)).cast("string"), 20, "0") for c, m in zip(names, most)], F.lpad(F.col(group).cast("string"), 40, " "))
    placed = ordered_index(per.withColumns({"__s": F.negate(size), "__tie": tie}), "__s", "__tie", "__pos", total="__groups").drop("__s", "__tie")
    groups = placed.select("__groups").first()
    wanted, able = folds, min(folds, totals[0][1], groups["__groups"] if groups else 0)
    while able >= 2:
        turn = (F.col("__pos") - 1) % (2 * able)
        fold = F.when(turn < able, turn).otherwise(2 * able - 1 - turn).cast("int")
        dealt = placed.withColumn("fold", fold)
        held = dealt.groupBy("fold").agg(*[F.sum(c).alias(c) for c in names]).collect()
        short = [r for r in held if any(r[c] == 0 or r[c] == n for c, (_, n) in zip(names, totals))]
        if not short:
            reason = None if able == wanted else "a class is too small for more folds"
            return dealt.select(group, "n", "fold", *names), {"requested": wanted, "folds": able, "fallback_reason": reason, "classes": [v for v, _ in totals]}
        able -= 1
    raise ValueError("the classes cannot be spread over two folds")


# ------------------------------------------------------------------------------------------- group baselines


def group_moments(df: DataFrame, group: str, features, target: str) -> DataFrame:
    """(group, m): sums of products of [1, features, target] for each group, one row a group whatever its size."""
    names = [F.lit(1.0), *[F.col(c).cast("double") for c in [*features, target]]]
    d = len(names)
    rows = df.dropna(subset=[*features, target])
    sums = [F.sum(names[i] * names[j]).alias(f"m{i * d + j}") for i in range(d) for j in range(i, d)]
    at = {(i, j): f"m{i * d + j}" for i in range(d) for j in range(i, d)}
    out = rows.groupBy(group).agg(*sums)
    return out.select(group, F.array(*[F.col(at[min(i, j), max(i, j)]) for i in range(d) for j in range(d)]).alias("m"))


def leave_group_out_ridge(df: DataFrame, group: str, features, target: str, alpha: float, out: str = "ridge", mean: str = "train_mean", least: int = 5) -> DataFrame:
    """Every row predicted by the ridge and the mean of all rows outside its group; null where fewer than ``least`` are outside.

    A group's training sums are the table's less its own, so each group is solved from d x d numbers.
    """
    names, d = list(features), len(list(features)) + 2
    m = group_moments(df, group, names, target)
    total = np.array(m.agg(*[F.sum(F.col("m")[i]) for i in range(d * d)]).first(), dtype=float).reshape(d, d)

    def solve(batches):
        for pdf in batches:
            rows = []
            for own in pdf["m"]:
                rest = total - np.asarray(own, float).reshape(d, d)
                if rest[0, 0] < least:
                    rows.append((None, None, None))
                    continue
                fit = ridge(rest, names, alpha)
                rows.append((rest[0, -1] / rest[0, 0], fit.intercept, list(fit.coefficients)))
            yield pd.DataFrame({group: pdf[group], mean: [r[0] for r in rows], "__b": [r[1] for r in rows], "__w": [r[2] for r in rows]})

    kind = df.schema[group].dataType.simpleString()
    fits = m.mapInPandas(solve, f"`{group}` {kind}, `{mean}` double, __b double, __w array<double>")
    scored = null_safe_join(df, fits, [group], "left")
    value = F.col("__b")
    for i, c in enumerate(names):
        value = value + F.col("__w")[i] * F.col(c)
    return scored.withColumn(out, value).drop("__b", "__w")


def baseline_table(df: DataFrame, group: str, target: str, models, baseline: str, *, replicates: int, seed: int) -> DataFrame:
    """Per model: rows, groups, MAE, RMSE, mean change of the absolute error against ``baseline`` and its group-bootstrap interval."""
    from proofmill.operators.resample import replicated

    long = df.select(group, F.col(target).alias("y"), F.col(baseline).alias("b"), F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).alias("p")) for c in models])).alias("x")).select("*", "x.*")
    long = long.where("p is not null and b is not null and y is not null")
    e, e0 = F.abs(F.col("y") - F.col("p")), F.abs(F.col("y") - F.col("b"))
    g = long.groupBy("model", group).agg(F.count(F.lit(1)).alias("n"), F.sum(e).alias("ae"), F.sum(F.pow(F.col("y") - F.col("p"), 2)).alias("se"), F.sum(e - e0).alias("de"))
    point = g.groupBy("model").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), (F.sum("ae") / F.sum("n")).alias("mae"), F.sqrt(F.sum("se") / F.sum("n")).alias("rmse"), (F.sum("de") / F.sum("n")).alias("delta_mae")
    )
    reps = replicated(g, group, replicates, seed).groupBy("model", "rep").agg((F.sum(F.col("weight") * F.col("de")) / F.sum(F.col("weight") * F.col("n"))).alias("d"))
    limits = reps.groupBy("model").agg(F.percentile("d", F.lit(0.025)).alias("lower"), F.percentile("d", F.lit(0.975)).alias("upper"), F.avg((F.col("d") < 0).cast("double")).alias("probability_better"))
    return point.join(limits, "model")
