import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from proofmill.operators import models as MD


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 2)) * [1, 3] + [5, 0]
    y = 2 + x @ [1.5, -0.5] + rng.normal(size=600) * 0.5
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y, "fold": np.arange(600) % 4})
    return pdf, spark.createDataFrame(pdf)


def test_ridge_from_sums(data):
    pdf, df = data
    s = MD.moment_sums(df, ["a", "b"], "y", "fold")
    m = MD.ridge(sum(s.values()), ["a", "b"], 0.0)
    want = np.linalg.lstsq(np.column_stack([np.ones(600), pdf.a, pdf.b]), pdf.y, rcond=None)[0]
    np.testing.assert_allclose([m.intercept, *m.coefficients], want, rtol=1e-8)
    p = MD.out_of_fold(df, s, ["a", "b"], "fold", 0.0, "p").toPandas()
    rows = MD.cross_validate(s, ["a", "b"], (0.0,))
    assert abs(rows[0]["rmse"] - np.sqrt(((p.y - p.p) ** 2).mean())) < 1e-8


def test_censored_fit_recovers_truth(data):
    _, df = data
    y = F.col("y")
    d = df.withColumns({"lo": F.when(y > 10, 10.0).when(y < 7, None).otherwise(y), "hi": F.when(y > 10, None).when(y < 7, 7.0).otherwise(y)})
    f = MD.censored_ridge(d, ["a", "b"], "lo", "hi", alpha=0.0)
    np.testing.assert_allclose(f["model"].coefficients, [1.5, -0.5], atol=0.1)
    assert abs(f["sigma"] - 0.5) < 0.08
    naive = MD.censoring_scenarios(d, ["a", "b"], "lo", "hi", alpha=0.0)[2]
    assert abs(naive["a"] - 1.5) > abs(f["model"].coefficients[0] - 1.5)


def test_train_only_standardisation(spark):
    d = spark.createDataFrame([(1.0, True), (3.0, True), (None, True), (100.0, False)], "v double, tr boolean")
    got = [r.v_std for r in MD.standardize_by_train(d, ["v"], "tr").collect()]
    assert got == [-1.0, 1.0, 0.0, 98.0]


def test_calibration_and_hybrid_never_see_the_scored_fold(spark):
    r = np.random.default_rng(3)
    y = r.integers(0, 2, 300)
    pdf = pd.DataFrame({"id": np.arange(300), "label": y.astype(float), "score": np.clip(0.3 * y + r.random(300) * 0.6, 0.01, 0.99), "fold": np.arange(300) % 3})
    df = spark.createDataFrame(pdf)
    got = MD.cross_calibrated(df, "label", "score", "fold", range(3)).toPandas().set_index("id").calibrated
    pdf.loc[pdf.fold == 0, "label"] = 1 - pdf.label[pdf.fold == 0]  # other labels in fold 0 leave its own scores alone
    again = MD.cross_calibrated(spark.createDataFrame(pdf), "label", "score", "fold", range(3)).toPandas().set_index("id").calibrated
    zero = pdf.id[pdf.fold == 0]
    np.testing.assert_allclose(got[zero], again[zero], atol=1e-6)
    assert not np.allclose(got.drop(zero), again.drop(zero), atol=1e-3)


def test_cluster_holdout_keeps_clusters_whole(spark):
    r = np.random.default_rng(5)
    v = [(int(i), [float(x) for x in r.normal(size=3) + 8 * (i % 5)]) for i in range(200)]
    g = MD.cluster_groups(spark.createDataFrame(v, "id int, v array<double>"), "id", "v")
    s = MD.cluster_holdout(g, "id").toPandas()
    assert len(s) == 200 and s.groupby("cluster").role.nunique().max() == 1 and set(s.role) == {"train", "test"}
    assert g.select("cluster").distinct().count() <= 14


def test_pruned_candidates_are_not_scored_again(spark, data):
    pdf, _ = data
    df = spark.createDataFrame(pdf.assign(g=[f"g{i % 60}" for i in range(600)]))
    subsets = {"both": ("a", "b"), "a": ("a",), "b": ("b",)}
    rows = MD.successive_halving(df, ["a", "b"], "y", "fold", "g", (0.1, 10.0, 1000.0), subsets, fractions=(0.3, 0.6, 1.0), seed=2)
    stages = {s: [r for r in rows if r["stage"] == s] for s in (1, 2, 3)}
    assert len(stages[1]) == 9 and len(stages[1]) > len(stages[2]) > len(stages[3])
    for s in (1, 2):
        kept = {(r["family"], r["alpha"]) for r in stages[s] if r["kept"]}
        assert {(r["family"], r["alpha"]) for r in stages[s + 1]} == kept
        assert {f for f, _ in kept} == set(subsets)  # the best of every family goes on
    assert stages[1][0]["n"] < stages[2][0]["n"] < stages[3][0]["n"] == 600
    (best,) = [r for r in stages[3] if r["kept"]]
    assert best["family"] == "both"


def test_nested_validation_never_sees_the_outer_fold(data):
    pdf, df = data
    sums = MD.moment_sums(df, ["a", "b"], "y", "fold")
    subsets = {"both": ("a", "b"), "a": ("a",)}
    for r in MD.nested_validation(sums, ["a", "b"], (0.1, 1000.0), subsets):
        inner = {k: v for k, v in sums.items() if k != r["fold"]}
        scores = {(f, a): MD.score_candidates(inner, ["a", "b"], [(f, a)], subsets)[0]["rmse"] for f in subsets for a in (0.1, 1000.0)}
        assert scores[r["family"], r["alpha"]] == min(scores.values()) == r["inner_rmse"]
        part = pdf[pdf.fold == r["fold"]]
        fit = MD.ridge(sum(inner.values()), ["a", "b"], r["alpha"], subsets[r["family"]])
        p = fit.intercept + sum(part[c] * b for c, b in zip(fit.features, fit.coefficients))
        assert r["outer_rmse"] == pytest.approx(np.sqrt(((part.y - p) ** 2).mean()))


def test_seeded_refits_differ_and_agree_with_weighted_fits(spark, data):
    from proofmill.operators.resample import replicated

    pdf, _ = data
    pdf = pdf.assign(g=[f"g{i % 40}" for i in range(600)])
    df = spark.createDataFrame(pdf)
    fits = {r.seed: r for r in MD.seeded_refits(df, "g", ["a", "b"], "y", 0.0, 5, 9).collect()}
    assert len({r.intercept for r in fits.values()}) == 5
    weights = {(r.rep, r.g): r.weight for r in replicated(df.select("g").distinct(), "g", 5, 9).collect()}
    for s, r in fits.items():
        w = np.sqrt([weights.get((s, g), 0) for g in pdf.g])
        want = np.linalg.lstsq(np.column_stack([np.ones(600), pdf.a, pdf.b]) * w[:, None], pdf.y * w, rcond=None)[0]
        np.testing.assert_allclose([r.intercept, *r.coefficients], want, rtol=1e-6)
    spread = MD.seed_stability(df, MD.seeded_refits(df, "g", ["a", "b"], "y", 0.0, 5, 9), ["a", "b"]).first()
    p = [r.intercept + r.coefficients[0] * spread.a + r.coefficients[1] * spread.b for r in fits.values()]
    assert (spread.mean, spread.sd, spread.range) == pytest.approx((np.mean(p), np.std(p, ddof=1), max(p) - min(p)))


def test_classifiers_score_in_a_session_that_has_observed(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.sql import Observation

    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + rng.normal(size=200) * 0.5 > 0).astype(float)
    df = spark.createDataFrame([(i, float(a), float(b), float(c), i % 2) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, label double, fold int")
    d = MD.assemble(df, ["a", "b"])
    cands = {"prior": ("prior", {}), "logistic": ("logistic", {"regParam": 0.1}), "forest": ("forest", {"numTrees": 3, "seed": 1})}
    got = MD.classifier_out_of_fold(d, "label", "fold", range(2), cands).toPandas()
    assert got.groupby("candidate").size().to_dict() == {"prior": 200, "logistic": 200, "forest": 200}
    m = LogisticRegression(regParam=0.1).fit(d.where("fold <> 0"))
    want = 1 / (1 + np.exp(-(x[::2] @ m.coefficients.toArray() + m.intercept)))
    part = got[(got.candidate == "logistic") & (got.fold == 0)].sort_values("id")
    np.testing.assert_allclose(part.score, want, rtol=1e-9)
    h = df.withColumn("v", F.array("a", "b")).drop("a", "b")
    hybrid = MD.hybrid_out_of_fold(h, "v", "label", "fold", range(2), 1, 2, regParam=0.1).toPandas()
    assert len(hybrid) == 200 and hybrid.score.between(0, 1).all()
