"""Model comparison on tables: ridge from moment sums, censored ridge, MLlib trees and logits.

Linear fits never move rows: one pass per table reduces it to cross-products per fold, every fold,
penalty and feature subset is then solved from those sums, and predictions are column expressions.
"""

from __future__ import annotations

from functools import reduce

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moment_sums(df: DataFrame, features, target: str, key: str | None = None) -> dict:
    """{key: (d+2)x(d+2) matrix of sums over [1, features, target]}; keys are few (folds, replicates).

    Each task adds up its own batches with one matrix product, so a partition ships d^2 numbers.
    """
    names = list(features)
    d = len(names) + 2
    k = F.col(key).cast("long") if key else F.lit(0).cast("long")
    src = df.select(k.alias("__k"), *[F.col(c).cast("double").alias(c) for c in [*names, target]]).dropna()

    def reduce_batches(batches):
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            for g, part in pdf.groupby("__k"):
                x = np.column_stack([np.ones(len(part)), part[[*names, target]].to_numpy(float)])
                acc[g] = acc.get(g, 0.0) + x.T @ x
        for g, m in acc.items():
            yield pd.DataFrame({"k": g, "i": np.arange(d * d), "v": m.ravel()})

    sums = src.mapInPandas(reduce_batches, "k long, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v"))
    out: dict = {}
    for r in sums.collect():  # keys x d^2 numbers
        out.setdefault(r.k, np.zeros(d * d))[r.i] = r.v
    return {g: m.reshape(d, d) for g, m in out.items()}


@dataclass
class Linear:
    features: tuple
    intercept: float
    coefficients: tuple

    def expr(self) -> Column:
        out = F.lit(float(self.intercept))
        for c, b in zip(self.features, self.coefficients):
            out = out + F.col(c) * F.lit(float(b))
        return out


def _view(m: np.ndarray, names, subset):
    idx = [0, *[1 + list(names).index(c) for c in subset], m.shape[0] - 1]
    return m[np.ix_(idx, idx)]


def ridge(m: np.ndarray, names, alpha: float, subset=None) -> Linear:
    """Ridge on columns standardised with the same training sums; the intercept is not penalised."""
    subset = list(subset or names)
    m = _view(m, names, subset)
    n = m[0, 0]
    mean = m[0, 1:-1] / n
    ym = m[0, -1] / n
    cov = m[1:-1, 1:-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    sd[sd < 1e-12] = 1.0
    cxy = (m[1:-1, -1] / n - mean * ym) / sd
    b = np.linalg.solve(cov / np.outer(sd, sd) + np.eye(len(sd)) * alpha / n, cxy) / sd
    return Linear(tuple(subset), float(ym - b @ mean), tuple(map(float, b)))


def sse(m: np.ndarray, names, model: Linear) -> float:
    """Squared error of a linear model on the rows behind ``m``, from the sums alone."""
    v = _view(m, names, model.features)
    b = np.array([model.intercept, *model.coefficients])
    return float(v[-1, -1] - 2 * b @ v[:-1, -1] + b @ v[:-1, :-1] @ b)


def score_candidates(sums: dict, names, candidates, subsets: dict) -> list[dict]:
    """Grouped CV error of each (family, penalty) among ``candidates``; folds come from the sums' keys."""
    total = sum(sums.values())
    rows = []
    for family, alpha in candidates:
        err = n = 0.0
        for m in sums.values():
            err += sse(m, names, ridge(total - m, names, alpha, subsets[family]))
            n += m[0, 0]
        rows.append({"family": family, "alpha": float(alpha), "n": int(n), "rmse": math.sqrt(max(err / n, 0.0))})
    return rows


def cross_validate(sums: dict, names, alphas, subsets=None) -> list[dict]:
    """Grouped CV error of every (feature subset, penalty), and of the out-of-fold mean."""
    subsets = subsets or {"all": tuple(names)}
    total = sum(sums.values())
    rows = score_candidates(sums, names, [(label, a) for label in subsets for a in alphas], subsets)
    # the dummy: out-of-fold mean
    err = n = 0.0
    for m in sums.values():
        mean = (total - m)[0, -1] / (total - m)[0, 0]
        err += m[-1, -1] - 2 * mean * m[0, -1] + mean * mean * m[0, 0]
        n += m[0, 0]
    rows.append({"family": "mean", "alpha": 0.0, "n": int(n), "rmse": math.sqrt(max(err / n, 0.0))})
    return rows


def nested_validation(sums: dict, names, alphas, subsets: dict) -> list[dict]:
    """One row for each outer fold: the candidate that the other folds choose among themselves, and its error on the fold.

    Inner and outer fits all come from one table of moments, so no row is read again.
    """
    grid = [(label, a) for label in subsets for a in alphas]
    out = []
    for f, m in sorted(sums.items()):
        inner = {k: v for k, v in sums.items() if k != f}
        best = min(score_candidates(inner, names, grid, subsets), key=lambda r: (round(r["rmse"], 12), r["family"], r["alpha"]))
        err = sse(m, names, ridge(sum(inner.values()), names, best["alpha"], subsets[best["family"]]))
        out.append({"fold": int(f), "family": best["family"], "alpha": best["alpha"], "inner_rmse": best["rmse"], "n": int(m[0, 0]), "outer_rmse": math.sqrt(max(err / m[0, 0], 0.0))})
    return out


def out_of_fold(df: DataFrame, sums: dict, names, fold: str, alpha: float, out: str, subset=None) -> DataFrame:
    """Each row predicted by the model of the other folds."""
    total = sum(sums.values())
    chain = None
    for f, m in sorted(sums.items()):
        e = ridge(total - m, names, alpha, subset).expr()
        chain = F.when(F.col(fold) == f, e) if chain is None else chain.when(F.col(fold) == f, e)
    return df.withColumn(out, chain)


def grouped_benchmark(df: DataFrame, features, target: str, fold: str, alphas, coverage: float = 0.9) -> DataFrame:
    """Best ridge by CV, its out-of-fold predictions, cross-conformal radius and coverage per fold."""
    from proofmill.operators.metrics import cross_conformal

    s = moment_sums(df, features, target, fold)
    best = min((r for r in cross_validate(s, features, alphas) if r["family"] == "all"), key=lambda r: (r["rmse"], r["alpha"]))
    p = out_of_fold(df, s, features, fold, best["alpha"], "predicted").withColumn("residual", F.col(target) - F.col("predicted"))
    return cross_conformal(p, "residual", fold, len(s), coverage).withColumn("alpha", F.lit(best["alpha"]))


def successive_halving(df: DataFrame, features, target: str, fold: str, group: str, alphas, subsets: dict, *, fractions=(0.25, 0.5, 1.0), seed: int) -> list[dict]:
    """Candidates scored on growing samples of whole groups, one row for each candidate and stage that scored it.

    After a stage the better half and the best of every family go on; the others are not scored again.  A stage is one
    pass over its rows, whatever the number of candidates.
    """
    from proofmill.functions.draws import hash_unit

    left, out = [(label, a) for label in subsets for a in alphas], []
    for stage, fraction in enumerate(fractions, 1):
        part = df if fraction >= 1 else df.where(hash_unit(F.lit(seed), F.col(group)) < fraction)
        rows = score_candidates(moment_sums(part, features, target, fold), features, left, subsets)
        rows.sort(key=lambda r: (round(r["rmse"], 12), r["family"], r["alpha"]))
        last = stage == len(fractions)
        keep = {(r["family"], r["alpha"]) for r in rows[: 1 if last else max(1, len(rows) // 2)]}
        if not last:
            keep |= {(r["family"], r["alpha"]) for i, r in enumerate(rows) if r["family"] not in {q["family"] for q in rows[:i]}}
        out += [dict(r, stage=stage, kept=(r["family"], r["alpha"]) in keep) for r in rows]
        left = [c for c in left if (c[0], float(c[1])) in keep]
    return out


def standardize_by_train(df: DataFrame, columns, train: str) -> DataFrame:
    """Impute with the train mean and scale with the train deviation; test rows never contribute."""
    tr = F.col(train)
    s = df.agg(
        *[F.avg(F.when(tr, F.col(c))).alias(f"m_{c}") for c in columns], *[F.stddev_pop(F.when(tr, F.col(c))).alias(f"s_{c}") for c in columns]
    ).first()
    new = {}
    for c in columns:
        m, sd = s[f"m_{c}"] or 0.0, s[f"s_{c}"] or 1.0
        new[f"{c}_std"] = (F.coalesce(F.col(c), F.lit(m)) - F.lit(m)) / F.lit(sd)
    return df.withColumns(new)


def merge_layers(base: DataFrame, layers, key: str, allowed, eligible: str) -> DataFrame:
    """Left-join feature layers; unlisted columns fail, ineligible rows get NULL features."""
    out = base
    for layer in layers:
        extra = [c for c in layer.columns if c != key]
        bad = [c for c in extra if c not in allowed]
        if bad:
            raise ValueError(f"feature columns not on the allow-list: {bad}")
        out = out.join(layer, key, "left").withColumns({c: F.when(F.col(eligible), F.col(c)) for c in extra})
    return out


_erfc = np.vectorize(math.erfc, otypes=[float])


def _tail(a):
    """(1 - Phi(a), hazard phi/(1-Phi)) with an asymptotic form far out."""
    t = np.maximum(0.5 * _erfc(a / math.sqrt(2)), 1e-300)
    h = np.where(a > 30, a + 1 / np.maximum(a, 1), np.exp(-0.5 * a * a) / math.sqrt(2 * math.pi) / t)
    return t, h


def _censored_terms(x, lo, hi, beta, s):
    """Log likelihood, gradient and Hessian sums for exact, one-sided and interval rows."""
    sig = math.exp(s)
    mu = x @ beta
    n = len(mu)
    ll, gm, gs, hmm, hms, hss = (np.zeros(n) for _ in range(6))
    has_lo, has_hi = np.isfinite(lo), np.isfinite(hi)
    ex = has_lo & has_hi & (np.abs(lo - hi) < 1e-12)
    z = (np.where(ex, lo, 0) - mu) / sig
    ll[ex], gm[ex], gs[ex] = (-s - 0.5 * z**2 - 0.5 * math.log(2 * math.pi))[ex], (z / sig)[ex], (z**2 - 1)[ex]
    hmm[ex], hms[ex], hss[ex] = -1 / sig**2, (-2 * z / sig)[ex], (-2 * z**2)[ex]
    r = has_lo & ~has_hi
    if r.any():
        a = (lo[r] - mu[r]) / sig
        t, h = _tail(a)
        k = h * (h - a)
        ll[r], gm[r], gs[r] = np.log(t), h / sig, h * a
        hmm[r], hms[r], hss[r] = -k / sig**2, -(a * k + h) / sig, -(a**2) * k - a * h
    lft = has_hi & ~has_lo
    if lft.any():
        b = (hi[lft] - mu[lft]) / sig
        t, g = _tail(-b)
        k = -g * (g + b)
        ll[lft], gm[lft], gs[lft] = np.log(t), -g / sig, -g * b
        hmm[lft], hms[lft], hss[lft] = k / sig**2, (b * k + g) / sig, b**2 * k + b * g
    iv = has_lo & has_hi & ~ex
    if iv.any():
        a, b = (lo[iv] - mu[iv]) / sig, (hi[iv] - mu[iv]) / sig
        pa, pb = np.exp(-0.5 * a * a) / math.sqrt(2 * math.pi), np.exp(-0.5 * b * b) / math.sqrt(2 * math.pi)
        dd = np.maximum(0.5 * (_erfc(a / math.sqrt(2)) - _erfc(b / math.sqrt(2))), 1e-300)
        ll[iv], gm[iv], gs[iv] = np.log(dd), -(pb - pa) / (sig * dd), -(b * pb - a * pa) / dd
        hmm[iv], hms[iv], hss[iv] = -gm[iv] ** 2, -gm[iv] * gs[iv], -gs[iv] ** 2
    d = x.shape[1]
    grad = np.append(x.T @ gm, gs.sum())
    hess = np.zeros((d + 1, d + 1))
    hess[:d, :d] = (x * hmm[:, None]).T @ x
    hess[:d, d] = hess[d, :d] = x.T @ hms
    hess[d, d] = hss.sum()
    return np.concatenate([[ll.sum(), n], grad, hess.ravel()])


def censored_ridge(df: DataFrame, features, lower: str, upper: str, *, alpha: float = 1.0, rounds: int = 25, tolerance: float = 1e-6) -> dict:
    """Gaussian regression with censored targets: Newton steps over distributed gradient and Hessian sums.

    NULL bounds are open sides.  Each round is one pass that returns (d+2)^2 numbers.
    """
    names = list(features)
    d = len(names) + 1
    src = df.select(*[F.col(c).cast("double").alias(c) for c in names], F.col(lower).cast("double").alias("__lo"), F.col(upper).cast("double").alias("__hi"))
    src = src.where(F.col("__lo").isNotNull() | F.col("__hi").isNotNull())
    mid = F.coalesce((F.col("__lo") + F.col("__hi")) / 2, "__lo", "__hi")
    # start from the fit that reads bounds as exact values
    m0 = moment_sums(src.withColumn("__mid", mid), names, "__mid")[0]
    start = ridge(m0, names, alpha)
    beta = np.array([start.intercept, *start.coefficients])
    s = 0.5 * math.log(max(sse(m0, names, start) / m0[0, 0], 1e-6))
    pen = np.append(0.0, np.full(d - 1, alpha))

    def total(beta, s):
        def run(batches):
            acc = None
            for pdf in batches:
                x = np.column_stack([np.ones(len(pdf)), pdf[names].to_numpy(float)])
                t = _censored_terms(x, pdf["__lo"].to_numpy(float), pdf["__hi"].to_numpy(float), beta, s)
                acc = t if acc is None else acc + t
            if acc is not None:
                yield pd.DataFrame({"i": np.arange(len(acc)), "v": acc})

        rows = src.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        v = np.zeros(2 + (d + 1) + (d + 1) ** 2)
        for r in rows:
            v[r.i] = r.v
        grad, hess = v[2 : 3 + d].copy(), v[3 + d :].reshape(d + 1, d + 1).copy()
        grad[:d] -= pen * beta
        hess[:d, :d] -= np.diag(pen)
        return v[0] - 0.5 * float(pen @ beta**2), int(v[1]), grad, hess

    obj, n, grad, hess = total(beta, s)
    for it in range(rounds):
        w, u = np.linalg.eigh(-hess)
        # where the surface is not concave, step by the size of the curvature instead
        step = u @ ((u.T @ grad) / np.maximum(np.abs(w), 1e-8 * np.abs(w).max()))
        scale = 1.0
        while True:
            nb, ns = beta + scale * step[:d], s + float(np.clip(scale * step[d], -1, 1))
            cand = total(nb, ns)
            if cand[0] >= obj - 1e-9 or scale < 1e-6:
                break
            scale /= 2
        gain = cand[0] - obj
        beta, s, (obj, n, grad, hess) = nb, ns, cand
        if gain < tolerance * (1 + abs(obj)):
            break
    return {"model": Linear(tuple(names), float(beta[0]), tuple(map(float, beta[1:]))), "sigma": math.exp(s), "objective": obj, "n": n, "rounds": it + 1}


def probability_at_least(model: Linear, sigma: float, threshold: float) -> Column:
    from proofmill.functions.values import normal_cdf

    return 1 - normal_cdf((F.lit(threshold) - model.expr()) / F.lit(sigma))


def censoring_scenarios(df: DataFrame, features, lower: str, upper: str, alpha: float = 1.0) -> list[dict]:
    """Proper likelihood, censored rows dropped, and bounds read as exact values."""
    lo, hi = F.col(lower), F.col(upper)
    exact = df.where(lo == hi)
    bound = df.withColumns({lower: F.coalesce(lo, hi), upper: F.coalesce(hi, lo)})
    out = []
    for name, d in (("proper", df), ("drop_censored", exact), ("boundary_as_exact", bound)):
        f = censored_ridge(d, features, lower, upper, alpha=alpha)
        out.append({"scenario": name, "n": f["n"], "sigma": f["sigma"], "intercept": f["model"].intercept, **dict(zip(features, f["model"].coefficients))})
    return out


def seeded_refits(df: DataFrame, group: str, features, target: str, alpha: float, seeds: int, seed: int = 0) -> DataFrame:
    """(seed, n, intercept, coefficients): one ridge for each seed, on groups that count by Poisson weights of their own.

    Every refit comes from per-group sums in one pass; a group draws its weight in each seed where it is.
    """
    from proofmill.operators.resample import replicated
    from proofmill.operators.splitplan import group_moments

    names, d = list(features), len(list(features)) + 2
    drawn = replicated(group_moments(df, group, names, target), group, seeds, seed)
    sums = drawn.groupBy("rep").agg(*[F.sum(F.col("weight") * F.col("m")[i]).alias(f"m{i}") for i in range(d * d)])

    def solve(batches):
        for pdf in batches:
            rows = []
            for values in pdf[[f"m{i}" for i in range(d * d)]].to_numpy(float):
                m = values.reshape(d, d)
                fit = ridge(m, names, alpha)
                rows.append((m[0, 0], fit.intercept, list(fit.coefficients)))
            yield pd.DataFrame({"seed": pdf["rep"], "n": [r[0] for r in rows], "intercept": [r[1] for r in rows], "coefficients": [r[2] for r in rows]})

    return sums.mapInPandas(solve, "seed int, n double, intercept double, coefficients array<double>")


def seed_stability(df: DataFrame, refits: DataFrame, features) -> DataFrame:
    """Each row's mean, deviation and range of the predictions of all refits (their number is a parameter)."""
    fits = sorted((r["seed"], r["intercept"], r["coefficients"]) for r in refits.collect())
    values = F.array(*[sum((F.col(c) * F.lit(float(b)) for c, b in zip(features, w)), F.lit(float(i))) for _, i, w in fits])
    n = len(fits)
    mean = F.aggregate("__p", F.lit(0.0), lambda a, v: a + v) / n
    spread = F.sqrt(F.aggregate("__p", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean"))) / max(1, n - 1))
    d = df.withColumn("__p", values).withColumn("mean", mean)
    return d.withColumns({"sd": spread, "range": F.array_max("__p") - F.array_min("__p")}).drop("__p")


def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="skip").transform(df)


def forest_out_of_fold(df: DataFrame, features, target: str, fold: str, folds, *, trees: int = 20, depth: int = 6, seed: int = 13) -> DataFrame:
    """Out-of-fold predictions of a random forest, one distributed fit per fold."""
    v = assemble(df, features)
    out = None
    for f in folds:
        rf = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed, predictionCol="predicted")
        p = rf.fit(v.where(F.col(fold) != f)).transform(v.where(F.col(fold) == f)).drop("features")
        out = p if out is None else out.unionByName(p)
    return out


def logistic_score(model, features: str = "features") -> Column:
    """Probability of label 1 from the fitted numbers alone.

    The model's own transform takes its training summary, and with it the session, into every task; a session that
    has observed a table cannot be sent.
    """
    w = F.array(*[F.lit(float(x)) for x in model.coefficients])
    terms = F.zip_with(vector_to_array(features), w, lambda x, y: x * y)
    return 1 / (1 + F.exp(-F.aggregate(terms, F.lit(float(model.intercept)), lambda s, x: s + x)))


def classifier_out_of_fold(df: DataFrame, label: str, fold: str, folds, candidates: dict, weight: str | None = None) -> DataFrame:
    """(candidate, rows) out-of-fold probabilities; ``df`` has a ``features`` vector.

    ``candidates``: name -> ('prior'|'logistic'|'forest', parameters).
    """
    out = None
    for name, (kind, params) in candidates.items():
        for f in folds:
            train, test = df.where(F.col(fold) != f), df.where(F.col(fold) == f)
            if kind == "prior":
                p = float(train.agg(F.avg(F.col(label).cast("double"))).first()[0])
                scored = test.withColumn("score", F.lit(p))
            else:
                cls = LogisticRegression if kind == "logistic" else RandomForestClassifier
                est = cls(featuresCol="features", labelCol=label, **params)
                if weight:
                    est = est.setWeightCol(weight)
                model = est.fit(train)
                if kind == "logistic":
                    scored = test.withColumn("score", logistic_score(model))
                else:  # a copy leaves the training summary behind
                    scored = model.copy().transform(test).withColumn("score", vector_to_array("probability")[1])
            r = scored.select(*[c for c in df.columns if c != "features"], "score").withColumn("candidate", F.lit(name))
            out = r if out is None else out.unionByName(r)
    return out


def sigmoid_calibration(train: DataFrame, df: DataFrame, label: str, score: str, out: str = "calibrated") -> DataFrame:
    """``df`` with its scores calibrated by a one-feature logistic fit on the logits of ``train``."""

    def logit(d):
        p = F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6))
        return d.withColumn("__logit", F.log(p / (1 - p)))

    m = LogisticRegression(featuresCol="__f", labelCol=label, maxIter=50).fit(assemble(logit(train), ["__logit"], "__f"))
    a, b = float(m.coefficients[0]), float(m.intercept)
    return logit(df).withColumn(out, 1 / (1 + F.exp(-(F.lit(a) * F.col("__logit") + F.lit(b))))).drop("__logit")


def cross_calibrated(df: DataFrame, label: str, score: str, fold: str, folds, out: str = "calibrated") -> DataFrame:
    """Every row calibrated by a fit on the rows of the other folds."""
    parts = [sigmoid_calibration(df.where(F.col(fold) != f), df.where(F.col(fold) == f), label, score, out) for f in folds]
    return reduce(DataFrame.unionByName, parts)


def score_bands(score: str) -> Column:
    s = F.col(score)
    return F.when(s < 0.3, "lower_concern").when(s < 0.7, "indeterminate").otherwise("high_concern")


def entropy(score: str) -> Column:
    p = F.least(F.greatest(F.col(score), F.lit(1e-12)), F.lit(1 - 1e-12))
    return -(p * F.log2(p) + (1 - p) * F.log2(1 - p))


def cluster_groups(df: DataFrame, key: str, vec: str, k: int | None = None, seed: int = 13) -> DataFrame:
    """(key, cluster) by k-means on an array column; k defaults to the root of the row count, from 3 to 64."""
    if k is None:
        n = df.count()
        k = max(1, min(n - 1, max(3, min(64, round(n**0.5)))))
    v = df.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(v).transform(v).select(key, F.col("prediction").alias("cluster"))


def cluster_holdout(groups: DataFrame, key: str, test_share: float = 0.2) -> DataFrame:
    """(key, cluster, role): whole clusters go to the test side, in hash order, while they fit into its share."""
    sizes = groups.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))  # at most k rows
    order = Window.orderBy(F.md5(F.col("cluster").cast("string")))
    sizes = sizes.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    sizes = sizes.select("cluster", F.when(F.col("upto") <= F.greatest(F.col("all") * test_share, F.min("n").over(Window.partitionBy())), "test").otherwise("train").alias("role"))
    return groups.join(F.broadcast(sizes), "cluster").select(key, "cluster", "role")


def residual_clusters(df: DataFrame, key: str, columns, k: int, seed: int = 13) -> DataFrame:
    """Median imputation, scaling, then k-means over residual profiles."""
    imp = Imputer(strategy="median", inputCols=list(columns), outputCols=[f"__i_{c}" for c in columns])
    pipe = Pipeline(
        stages=[
            imp,
            VectorAssembler(inputCols=[f"__i_{c}" for c in columns], outputCol="__raw"),
            StandardScaler(inputCol="__raw", outputCol="features", withMean=True),
            KMeans(k=k, seed=seed, maxIter=20),
        ]
    )
    return pipe.fit(df).transform(df).select(key, F.col("prediction").alias("cluster"))


def hybrid_features(train: DataFrame, df: DataFrame, vec: str, components: int, clusters: int, seed: int = 13) -> DataFrame:
    """``df`` with principal components and distances to k-means centres as ``features``, both fitted on ``train`` only."""
    fit, d = (x.withColumn("__v", array_to_vector(F.col(vec).cast("array<double>"))) for x in (train, df))
    p = PCA(k=components, inputCol="__v", outputCol="__pca").fit(fit).transform(d)
    km = KMeans(k=clusters, seed=seed, featuresCol="__v", predictionCol="__c", maxIter=20).fit(fit)
    x = vector_to_array("__v")
    dist = []
    for c in km.clusterCenters():
        lit = F.array(*[F.lit(float(a)) for a in c])
        dist.append(F.sqrt(F.aggregate(F.zip_with(x, lit, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, q: s + q)))
    return p.withColumn("features", array_to_vector(F.concat(vector_to_array("__pca"), F.array(*dist)))).drop("__v", "__pca")


def hybrid_out_of_fold(df: DataFrame, vec: str, label: str, fold: str, folds, components: int, clusters: int, **params) -> DataFrame:
    """Out-of-fold logistic scores on hybrid features; nothing is fitted on the fold that is scored."""
    parts = []
    for f in folds:
        train = df.where(F.col(fold) != f)
        h = hybrid_features(train, df, vec, components, clusters)
        m = LogisticRegression(featuresCol="features", labelCol=label, **params).fit(h.where(F.col(fold) != f))
        parts.append(h.where(F.col(fold) == f).withColumn("score", logistic_score(m)).select(*[c for c in df.columns if c != vec], "score"))
    return reduce(DataFrame.unionByName, parts)


def stack_experts(df: DataFrame, experts, target: str, fold: str, alpha: float = 1.0) -> DataFrame:
    """Non-negative, fold-wise ridge over out-of-fold expert predictions."""
    s = moment_sums(df, experts, target, fold)
    total = sum(s.values())
    chain = None
    for f, m in sorted(s.items()):
        use = list(experts)
        while True:
            fit = ridge(total - m, experts, alpha, use)
            neg = [c for c, b in zip(fit.features, fit.coefficients) if b < 0]
            if not neg or len(use) == 1:
                break
            use = [c for c in use if c not in neg] or use[:1]
        chain = F.when(F.col(fold) == f, fit.expr()) if chain is None else chain.when(F.col(fold) == f, fit.expr())
    return df.withColumn("stacked", chain)


def gate_experts(df: DataFrame, experts, features, target: str, fold: str, alpha: float = 1.0) -> DataFrame:
    """Pick, per row, the expert whose predicted absolute error is smallest (learned out of fold)."""
    d = df
    for e in experts:
        d = d.withColumn(f"__err_{e}", F.abs(F.col(target) - F.col(e)))
    for e in experts:
        s = moment_sums(d, features, f"__err_{e}", fold)
        d = out_of_fold(d, s, features, fold, alpha, f"__pe_{e}")
    errs = F.array(*[F.col(f"__pe_{e}") for e in experts])
    pick = F.array_position(errs, F.array_min(errs))
    names = F.array(*[F.lit(e) for e in experts])
    vals = F.array(*[F.col(e) for e in experts])
    d = d.withColumns({"gate_expert": F.element_at(names, pick.cast("int")), "gated": F.element_at(vals, pick.cast("int"))})
    return d.drop(*[f"__err_{e}" for e in experts], *[f"__pe_{e}" for e in experts])


def block_effects(df: DataFrame, row_id: str, features, block, target: str, fold: str, cell, *, alpha: float, replicates: int, seed: int) -> DataFrame:
    """Paired errors with a feature block intact, permuted inside cells, and left out."""
    from proofmill.operators.resample import permuted

    s = moment_sums(df, features, target, fold)
    rest = [f for f in features if f not in block]
    d = out_of_fold(df, s, features, fold, alpha, "full")
    d = out_of_fold(d, s, features, fold, alpha, "ablated", rest)
    d = d.withColumn("__block", F.struct(*block)).withColumn("__rest", F.struct(*[c for c in (fold, target, "full", "ablated", *rest)]))
    p = permuted(d, row_id, "__block", within=[cell], replicates=replicates, seed=seed, carry=("__rest",))
    p = p.select("rep", row_id, cell, "__rest.*", "permuted___block.*")
    p = out_of_fold(p, s, features, fold, alpha, "permuted")
    err = lambda c: F.abs(F.col(target) - F.col(c))
    return p.groupBy(row_id, cell).agg(
        F.avg(err("full")).alias("baseline_abs_error"), F.avg(err("permuted")).alias("permuted_abs_error"), F.avg(err("ablated")).alias("ablated_abs_error")
    )


def transfer_permutation(internal: DataFrame, external: DataFrame, row_id: str, features, target: str, holdout: DataFrame, *, alpha: float, replicates: int, seed: int) -> dict:
    """Gain of adding external rows on a holdout, against external labels shuffled among themselves."""
    from proofmill.operators.resample import permuted

    mi, me, mh = (moment_sums(x, features, target)[0] for x in (internal, external, holdout))

    def rmse(m):
        return math.sqrt(max(sse(mh, features, ridge(m, features, alpha)) / mh[0, 0], 0.0))

    base, gain = rmse(mi), 0.0
    gain = base - rmse(mi + me)
    ext = external.withColumn("__x", F.struct(*features))
    p = permuted(ext, row_id, target, replicates=replicates, seed=seed, carry=("__x",)).select("rep", "__x.*", F.col(f"permuted_{target}").alias(target))
    null = [base - rmse(mi + m) for m in moment_sums(p, features, target, "rep").values()]
    pv = (sum(g >= gain - 1e-12 for g in null) + 1) / (len(null) + 1)
    return {"baseline_rmse": base, "gain": gain, "null_mean_gain": float(np.mean(null)), "p_value": pv, "replicates": len(null)}
