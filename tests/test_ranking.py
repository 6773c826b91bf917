import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from proofmill.operators import aggregate as A
from proofmill.operators import joins as J
from proofmill.operators import metrics as M
from proofmill.operators import ranking as R
from proofmill.operators import resample as S
from proofmill.operators import splits as P


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({"id": [f"r{i:05d}" for i in range(n)], "k": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 40, n).astype(str)), "v": np.round(rng.normal(size=n), 2), "y": rng.integers(0, 2, n), "fold": rng.integers(0, 5, n)})
    return pdf, spark.createDataFrame(pdf)


def test_grouped_quantiles_with_hot_key(skewed):
    pdf, df = skewed
    got = R.group_quantiles(df, "v", {"m": 0.5, "q": 0.9}, ["k"]).toPandas().set_index("k").sort_index()
    want = pdf.groupby("k").v.quantile([0.5, 0.9]).unstack().sort_index()
    np.testing.assert_allclose(got["m"], want[0.5])
    np.testing.assert_allclose(got["q"], want[0.9])
    hi = R.group_quantiles(df, "v", {"h": 0.37}, kind="higher").first().h
    assert hi == np.quantile(pdf.v, 0.37, method="higher")


def test_ranks_and_orders(skewed):
    pdf, df = skewed
    got = R.with_average_rank(df, "v", "r", ["k"]).toPandas().set_index("id").r.sort_index()
    np.testing.assert_allclose(got, pdf.assign(r=pdf.groupby("k").v.rank()).set_index("id").r.sort_index())
    o = R.ordered_index(df, "v", "id", "o").toPandas().set_index("id").o
    want = pdf.sort_values(["v", "id"]).id.tolist()
    assert o.sort_values().index.tolist() == want
    g = R.ordered_index(df, "v", "id", "o", keys=["k"]).toPandas()
    assert (g.sort_values(["k", "o"]).groupby("k").o.apply(lambda s: s.tolist() == list(range(1, len(s) + 1)))).all()


def test_rank_is_independent_of_partitioning(skewed):
    _, df = skewed
    a = R.ordered_index(df.repartition(1), "v", "id", "o").select("id", "o").toPandas().sort_values("id").o.tolist()
    b = R.ordered_index(df.repartition(13), "v", "id", "o").select("id", "o").toPandas().sort_values("id").o.tolist()
    assert a == b


def test_bh_and_hashed_index(spark, skewed):
    rng = np.random.default_rng(1)
    p = np.round(rng.random(200), 3)
    df = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(p)], "i int, p double").unionAll(spark.createDataFrame([(999, None)], "i int, p double"))
    q = R.benjamini_hochberg(df, "p", "q").toPandas().set_index("i").q
    order = np.argsort(p, kind="stable")
    adj = np.minimum.accumulate((p[order] * 200 / np.arange(1, 201))[::-1])[::-1]
    want = np.empty(200)
    want[order] = np.minimum(adj, 1)
    # equal p-values share the smallest adjusted value
    want = pd.Series(want).groupby(p).transform("min").to_numpy()
    np.testing.assert_allclose(q.loc[range(200)].to_numpy(), want)
    assert np.isnan(q.loc[999])
    idx = R.hashed_index(df.where("i < 200"), "i").toPandas().idx
    assert sorted(idx) == list(range(200))


def test_classification_metrics_against_numpy(skewed):
    pdf, df = skewed
    d = df.withColumn("s", 1 / (1 + F.exp(-F.col("v"))))
    m = M.classification_metrics(d, "y", "s").first()
    s = pdf.v.to_numpy()
    pos, neg = s[pdf.y == 1], s[pdf.y == 0]
    auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / len(pos) / len(neg)
    assert abs(m.roc_auc - auc) < 1e-9


def test_conformal(skewed):
    pdf, df = skewed
    r = np.abs(pdf.v.to_numpy())
    q = min(1.0, np.ceil((len(r) + 1) * 0.9) / len(r))
    assert M.conformal_radius(df, "v", 0.9).first().radius == np.quantile(r, q, method="higher")
    got = M.cross_conformal(df, "v", "fold", 5, 0.9).toPandas().set_index("fold").radius
    for f in range(5):
        o = r[pdf.fold != f]
        assert got[f] == np.quantile(o, min(1.0, np.ceil((len(o) + 1) * 0.9) / len(o)), method="higher")


def test_bootstrap_is_deterministic_and_complete(skewed):
    _, df = skewed
    groups = df.select("k").distinct()
    w = S.replicated(groups, "k", 400, 5)
    per = w.groupBy("rep").agg(F.sum("weight").alias("w")).collect()
    n = groups.count()
    assert abs(np.mean([r.w for r in per]) - n) < 4 * (n / 400) ** 0.5  # Poisson(1) a group
    assert abs(np.var([r.w for r in per]) / n - 1) < 0.4
    a = S.paired_bootstrap(df, "k", "v", replicates=30, seed=1).first()
    assert a == S.paired_bootstrap(df.repartition(9), "k", "v", replicates=30, seed=1).first() or abs(a.effect) < 1


def test_permutation_keeps_cells(skewed):
    pdf, df = skewed
    p = S.permuted(df, "id", "v", within=["k"], replicates=2, seed=3).toPandas()
    for rep, part in p.groupby("rep"):
        assert sorted(part[part.k == "hot"].permuted_v) == sorted(pdf[pdf.k == "hot"].v)


def test_splits(skewed):
    _, df = skewed
    h = P.group_holdout(df, "k", "y", test_size=0.3)
    assert P.split_audit(h, "k").first().overlapping_groups == 0
    f = P.group_folds(df, "k", 3).toPandas()
    assert f.k.is_unique and set(f.fold) == {0, 1, 2}
    dated = df.withColumn("yr", F.when(F.col("k") != "hot", F.col("k").cast("int")))
    t = P.temporal_holdout(dated, "k", "yr", test_size=0.2)
    assert t.where("k = 'hot' and role = 'test'").isEmpty()
    lo = t.where("role = 'test'").agg(F.min("yr")).first()[0]
    hi = t.where("role = 'train'").agg(F.max("yr")).first()[0]
    assert hi < lo


def test_uniques_and_consensus(spark):
    d = spark.createDataFrame([("a", f"v{i:03d}") for i in range(50)] + [("b", None), ("b", " ")], "k string, v string")
    u = {r.k: r.j for r in A.joined_uniques(d, ["k"], {"j": "v"}).collect()}
    assert u["a"] == ";".join(f"v{i:03d}" for i in range(50)) and not u.get("b")
    iv = spark.createDataFrame([("a", 5.0, 5.0), ("a", 5.2, 5.2), ("b", 5.0, None), ("b", None, 4.0), ("c", 5.0, 5.0), ("c", 6.0, None), ("d", 1.0, None), ("d", None, 3.0)], "k string, lo double, hi double")
    r = {x.k: x for x in A.interval_consensus(iv, ["k"], lower="lo", upper="hi", max_spread=0.3).collect()}
    assert r["a"].lower == 5.1 and r["b"].reason == "empty_intersection" and r["c"].reason == "exact_conflicts_with_censored"
    assert (r["d"].lower, r["d"].upper) == (1.0, 3.0)


def test_checked_join(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(J.CardinalityError):
        J.checked_join(a, a, "k")
