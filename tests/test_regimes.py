import numpy as np
import pytest

from proofmill.operators import regimes as RG

CUTS = (20.0, 40.0, 50.0, 60.0, 80.0)


def sample(spark, bend: float, seed: int = 1, n: int = 300):
    r = np.random.default_rng(seed)
    x, c = r.uniform(0, 100, n).round(2), r.normal(size=n).round(3)
    y = 0.05 * x + 1.5 * c + 0.01 * x * c + bend * np.maximum(x - 50, 0) + r.normal(0, 0.3, n)
    rows = [(f"g{i % 25}", float(a), float(b), None if i % 17 == 0 else float(k)) for i, (a, b, k) in enumerate(zip(x, y, c))]
    return rows, spark.createDataFrame(rows, "g string, x double, y double, c double").repartition(4)


def test_scan_against_least_squares(spark):
    rows, df = sample(spark, 0.2)
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    c = np.array([np.nan if r[3] is None else r[3] for r in rows])
    c = np.where(np.isnan(c), np.nanmedian(c), c)
    u = (x - x.mean()) / x.std()

    def fit(design):
        beta, *_ = np.linalg.lstsq(design, y, rcond=None)
        rss = ((y - design @ beta) ** 2).sum()
        return rss, len(y) * np.log(rss / len(y)) + design.shape[1] * np.log(len(y)), beta

    base = np.column_stack([np.ones(len(x)), u, c, u * c])
    got = {r.cut: r for r in RG.hinge_scan(df, "x", "y", CUTS, covariates=["c"]).collect()}
    assert set(got) == set(CUTS)
    for cut, r in got.items():
        rss, bic, beta = fit(np.column_stack([base, np.maximum(x - cut, 0) / x.std()]))
        assert r.rss == pytest.approx(rss, rel=1e-6) and r.bic == pytest.approx(bic, rel=1e-6)
        assert r.effect == pytest.approx(beta[-1], rel=1e-5) and r.baseline_bic == pytest.approx(fit(base)[1], rel=1e-6)
        assert (r.n_left, r.n_right) == ((x < cut).sum(), (x >= cut).sum())


def test_a_bend_is_chosen_and_a_line_is_not(spark):
    best = RG.best_hinge(RG.hinge_scan(sample(spark, 0.2)[1], "x", "y", CUTS, covariates=["c"])).first()
    assert best.cut == 50.0 and best.selected and best.probability > 0.99 and best.effect > 0
    none = RG.best_hinge(RG.hinge_scan(sample(spark, 0.0)[1], "x", "y", CUTS, covariates=["c"])).first()
    assert not none.selected and none.probability < 0.5


def test_both_sides_need_their_rows(spark):
    df = sample(spark, 0.2, n=60)[1]
    assert {r.cut for r in RG.hinge_scan(df, "x", "y", (1.0, 50.0, 99.0), minimum=10).collect()} == {50.0}
    assert RG.hinge_scan(df, "x", "y", CUTS, minimum=1000).count() == 0
    assert RG.hinge_scan(df.where("x is null"), "x", "y", CUTS).count() == 0
    assert RG.hinge_scan(df.selectExpr("5.0D as x", "y"), "x", "y", CUTS).count() == 0


def test_replicates_weight_whole_groups(spark):
    rows, df = sample(spark, 0.2)
    scan = RG.hinge_scan(df, "x", "y", CUTS, group="g", replicates=40, seed=3)
    sizes = {g: sum(r[0] == g for r in rows) for g, *_ in rows}
    assert {r.n for r in scan.where("rep = 0").collect()} == {300.0}
    assert all(r.n % min(sizes.values()) == 0 for r in scan.collect())
    s = RG.regime_summary(RG.best_hinge(scan), "y", 40).first()
    assert s.selected and s.selection_frequency > 0.9 and s.low <= 50 <= s.high and s.direction_stability > 0.9


def test_a_gate_needs_an_adjacent_outcome_that_overlaps(spark):
    kind = "outcome string, selected boolean, selection_frequency double, low double, high double, width double, direction_stability double, n_left double, n_right double"
    rows = [("a", True, 0.9, 40.0, 50.0, 10.0, 0.9, 99.0, 99.0), ("b", True, 0.8, 45.0, 60.0, 15.0, 0.9, 99.0, 99.0), ("c", True, 0.9, 70.0, 80.0, 10.0, 0.9, 99.0, 99.0), ("d", False, 0.1, None, None, None, 0.0, 3.0, 99.0)]
    d = spark.createDataFrame(rows, kind)
    got = {r.outcome: r for r in RG.outcome_gate(d, [("a", "b"), ("b", "c"), ("a", "d")]).collect()}
    assert got["a"].supported and got["b"].partners == "a" and not got["c"].supported and got["c"].passed
    assert got["d"].failures.count(";") == 4
    assert not any(r.supported for r in RG.outcome_gate(d, [("a", "c")]).collect())
