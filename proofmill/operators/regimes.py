"""Change of slope: a continuous line with a hinge at each candidate cut, covariates and their interactions, and gates over outcomes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.operators.resample import replicated


def _rss(m: np.ndarray) -> tuple[float, np.ndarray]:
    """Squared error and coefficients of the last column on the others, from sums of products; dependent columns get the least-norm fit."""
    a, b = m[:-1, :-1], m[:-1, -1]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    beta = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-12)[0] / scale
    return max(float(m[-1, -1] - beta @ b), 0.0), beta


def _bic(rss: float, n: float, columns: int) -> float:
    return n * np.log(max(rss / n, 1e-12)) + columns * np.log(n)


def hinge_scan(df: DataFrame, x: str, y: str, cuts, *, covariates=(), minimum: int = 15, group: str | None = None, replicates: int = 0, seed: int = 0) -> DataFrame:
    """(rep, cut, n, n_left, n_right, rss, bic, baseline_bic, delta_bic, effect), one row for each cut with ``minimum`` rows on both sides.

    Baseline: intercept, x, covariates and their products with x.  A cut adds max(x - cut, 0), in deviations of x; ``effect`` is
    its coefficient.  Gaps in covariates are filled with their medians; rows without x or y are left out.  Replicate 0 is the table;
    the others weight whole groups.  The rows are reduced to sums of products between neighbouring cuts, so every cut of every
    replicate is solved from a few small matrices.
    """
    cuts = sorted(float(c) for c in cuts)
    names = list(covariates)
    src = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if group:
        src = src.where(F.col(group).isNotNull())
    at = src.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), *[F.percentile(c, F.lit(0.5)).alias(f"q{i}") for i, c in enumerate(names)]).first()
    kinds = "rep int, cut double, n double, n_left double, n_right double, rss double, bic double, baseline_bic double, delta_bic double, effect double"
    if at.m is None or at.s <= 1e-9:
        return df.sparkSession.createDataFrame([], kinds)
    u = (F.col(x) - F.lit(float(at.m))) / F.lit(float(at.s))
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(float(at[f"q{i}"] or 0.0))) for i, c in enumerate(names)]
    z = [F.lit(1.0), u, *filled, *[u * c for c in filled], F.col(y).cast("double")]
    d = len(z)
    bin_ = sum(((F.col(x) >= c).cast("int") for c in cuts), F.lit(0))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    rows = src.select(bin_.alias("bin"), *([F.col(group).alias("g")] if group else []), *[e.alias(f"z{i}") for i, e in enumerate(z)])
    sums = [F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"m{k}") for k, (i, j) in enumerate(pairs)]
    moments = [f"m{k}" for k in range(len(pairs))]
    per = rows.groupBy(*(["g"] if group else []), "bin").agg(*sums)
    cells = per.groupBy("bin").agg(*[F.sum(m).alias(m) for m in moments]).withColumn("rep", F.lit(0))
    if replicates:
        drawn = replicated(per, "g", replicates, seed).groupBy("rep", "bin").agg(*[F.sum(F.col("weight") * F.col(m)).alias(m) for m in moments])
        cells = cells.unionByName(drawn)
    mean, deviation = float(at.m), float(at.s)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros((len(cuts) + 1, d, d))
        for b, values in zip(pdf["bin"], pdf[moments].to_numpy(float)):
            for (i, j), v in zip(pairs, values):
                full[b, i, j] = full[b, j, i] = v
        upper = np.cumsum(full[::-1], 0)[::-1]  # rows at or above each cut
        total = upper[0]
        n = total[0, 0]
        base = _bic(_rss(total)[0], n, d - 1) if n > 0 else np.nan
        out = []
        for k, cut in enumerate(cuts, 1):
            s, tau = upper[k], (cut - mean) / deviation
            right = s[0, 0]
            if n - right < minimum or right < minimum:
                continue
            h = s[1] - tau * s[0]  # sums of the hinge times each column
            hh = s[1, 1] - 2 * tau * s[0, 1] + tau * tau * s[0, 0]
            m = np.block([[total[:-1, :-1], h[:-1, None], total[:-1, -1:]], [h[None, :-1], np.array([[hh, h[-1]]])], [total[-1:, :-1], np.array([[h[-1], total[-1, -1]]])]])
            rss, beta = _rss(m)
            bic = _bic(rss, n, d)
            out.append((int(pdf["rep"].iloc[0]), cut, n, n - right, right, rss, bic, base, base - bic, float(beta[-1])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in kinds.split(", ")])

    return cells.groupBy("rep").applyInPandas(solve, kinds)


def best_hinge(scan: DataFrame, *, least_gain: float = 2.0, least_probability: float = 0.5) -> DataFrame:
    """Per replicate the cut with the least BIC and the probability of any hinge against none.

    Both families have equal prior mass, and the cuts share that of the hinge.
    """
    low = F.min("bic").over(Window.partitionBy("rep"))
    d = scan.withColumn("w", F.exp(-0.5 * (F.col("bic") - low)))
    g = d.groupBy("rep").agg(F.min_by(F.struct("cut", "n_left", "n_right", "effect", "delta_bic"), F.struct(F.round("bic", 9), "cut")).alias("b"), F.min("bic").alias("low"), F.first("baseline_bic").alias("base"), F.avg("w").alias("w"))
    odds = F.exp(F.least(F.lit(700.0), -0.5 * (F.col("base") - F.col("low")))) / F.col("w")
    probability = 1 / (1 + odds)
    return g.select("rep", "b.*", probability.alias("probability"), ((F.col("b.delta_bic") >= least_gain) & (probability >= least_probability)).alias("selected"))


def regime_summary(best: DataFrame, outcome: str, replicates: int) -> DataFrame:
    """One row for an outcome: the observed cut, how often replicates choose one, where, and whether its direction holds."""
    seen = best.where("rep = 0").select("cut", "n_left", "n_right", "effect", "probability", "selected").first()
    chosen = best.where("rep > 0 and selected")
    sign = float(np.sign(seen.effect)) if seen else 0.0
    g = chosen.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile("cut", F.lit(0.025)).alias("low"),
        F.percentile("cut", F.lit(0.975)).alias("high"),
        F.avg((F.signum("effect") == sign).cast("double")).alias("same"),
    )
    pick = lambda name, kind, default: F.lit(getattr(seen, name) if seen else default).cast(kind).alias(name)
    return g.select(
        F.lit(outcome).alias("outcome"), pick("cut", "double", None), pick("n_left", "double", 0.0), pick("n_right", "double", 0.0), pick("effect", "double", None), pick("probability", "double", None), pick("selected", "boolean", False),
        (F.col("n") / replicates).alias("selection_frequency"), "low", "high", (F.col("high") - F.col("low")).alias("width"), F.coalesce("same", F.lit(0.0)).alias("direction_stability"),
    )


def outcome_gate(summaries: DataFrame, adjacent, *, frequency: float = 0.7, width: float = 50.0, stability: float = 0.7, minimum: int = 15) -> DataFrame:
    """Each outcome with its failures and the adjacent outcomes that pass too and whose interval overlaps; ``supported`` needs one.

    ``adjacent``: pairs of outcomes that one mechanism connects.
    """
    checks = [
        (~F.col("selected"), "no segmented evidence"),
        (F.col("selection_frequency") < frequency, "selected too seldom"),
        (F.col("width").isNull() | (F.col("width") > width), "location too wide"),
        (F.col("direction_stability") < stability, "direction unstable"),
        (F.least("n_left", "n_right") < minimum, "too few rows on one side"),
    ]
    failures = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), name) for c, name in checks]))
    d = summaries.withColumn("failures", F.array_join(failures, ";")).withColumn("passed", F.col("failures") == "")
    both = [(a, b) for a, b in adjacent] + [(b, a) for a, b in adjacent]
    pairs = df_pairs(d.sparkSession, both)
    other = d.where("passed").select(F.col("outcome").alias("other"), F.col("low").alias("l"), F.col("high").alias("h"))
    met = d.where("passed").join(pairs, "outcome").join(other, "other").where("greatest(low, l) <= least(high, h)")
    met = met.groupBy("outcome").agg(F.array_join(F.array_sort(F.collect_set("other")), ";").alias("partners"))  # outcomes are few
    return d.join(met, "outcome", "left").withColumn("supported", F.col("partners").isNotNull()).withColumn("partners", F.coalesce("partners", F.lit("")))


def df_pairs(spark, pairs) -> DataFrame:
    return spark.createDataFrame([tuple(p) for p in pairs], "outcome string, other string").distinct()
