import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmill.operators import panels as PL


def points(spark, x, labels=None, series=None):
    rows = [(i, [float(v) for v in p], None if labels is None else labels[i], None if series is None else series[i]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id int, x array<double>, label string, series string").repartition(3)


def test_farthest_rows(spark):
    got = PL.constrained_panel(points(spark, [(i, 0) for i in range(11)]), "id", "x", 3).orderBy("place").collect()
    assert [r.id for r in got] == [10, 0, 5] and {r.reason for r in got} == {"distance"}


def test_information_by_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3)).round(3)
    series = [f"s{i % 5}" for i in range(40)]
    chosen = []
    while len(chosen) < 8:
        a = np.eye(3) + sum((np.outer(x[i], x[i]) for i in chosen), np.zeros((3, 3)))
        allowed = [i for i in range(40) if i not in chosen and sum(series[j] == series[i] for j in chosen) < 1] or [i for i in range(40) if i not in chosen]
        chosen.append(min(allowed, key=lambda i: (-round(np.linalg.slogdet(a + np.outer(x[i], x[i]))[1] - np.linalg.slogdet(a)[1], 9), i)))
    got = PL.constrained_panel(points(spark, x, series=series), "id", "x", 8, goal="information", series="series", per_series=1).orderBy("place").collect()
    assert [r.id for r in got] == chosen  # after five picks every series is full and the limit falls away


def test_mandatory_pairs_and_strata_come_first(spark):
    x = [(i % 7, i // 7) for i in range(35)]
    labels = ["rare" if i == 17 else "b" if i % 2 else None for i in range(35)]
    pairs = spark.createDataFrame([(3, 4, 9.0), (4, 5, 8.0), (8, 30, 7.0), (20, 21, 6.0), (40, 41, 99.0)], "id_a int, id_b int, gap double")
    d = points(spark, x, labels)
    got = PL.constrained_panel(d, "id", "x", 9, mandatory=[5, 99, 5], pairs=pairs.where("id_a < 40"), pair_order=[F.negate("gap"), F.col("id_a")], pair_slots=5, strata=["label"]).orderBy("place").collect()
    assert [(r.id, r.reason) for r in got[:5]] == [(5, "mandatory"), (3, "pair 1"), (4, "pair 1"), (8, "pair 2"), (30, "pair 2")]
    assert ("label rare", 17) in {(r.reason, r.id) for r in got} and len(got) == 9
    assert len({r.id for r in got}) == 9


def test_small_and_empty_tables(spark):
    d = points(spark, [(1, 2), (3, 4)])
    assert PL.constrained_panel(d, "id", "x", 5).count() == 2
    assert PL.constrained_panel(d.limit(0), "id", "x", 5).count() == 0
    with pytest.raises(ValueError):
        PL.constrained_panel(d, "id", "x", 5, goal="luck")


def test_pairs_and_rows_compete_for_the_places_of_a_series(spark):
    rows = [(i, "ab"[i % 2], float(i)) for i in range(12)]
    d = spark.createDataFrame(rows, "id int, series string, v double")
    pairs = spark.createDataFrame([(1, 3, "b", "b", 9.0), (0, 2, "a", "a", 8.0), (4, 5, "a", "b", 7.0), (6, 7, "a", "b", 6.0), (5, 8, "b", "a", 5.0)], "id_a int, id_b int, series_a string, series_b string, gap double")
    cats = [{"name": "top", "quota": 2, "where": F.col("v") >= 10, "order": [F.desc("v")]}, {"name": "pair", "quota": 5, "pairs": pairs, "order": [F.negate("gap")]}, {"name": "rest", "quota": 9, "where": F.lit(True), "order": [F.desc("v")]}]
    got = PL.mixed_quotas(d, "id", "series", cats, per_series=3).orderBy("place").collect()
    # 11 and 10 first; (1, 3) then fills series b, so no pair with b is left and (0, 2) fills series a
    assert [(r.id, r.category, r.pair) for r in got] == [(11, "top", None), (10, "top", None), (1, "pair", "pair 1"), (3, "pair", "pair 1"), (0, "pair", "pair 2"), (2, "pair", "pair 2")]
    two = PL.mixed_quotas(d, "id", "series", cats[1:2], per_series=1).collect()
    assert {r.id for r in two} == {4, 5}  # both of (1, 3) would need two places in b


def test_an_odd_quota_never_splits_a_pair(spark):
    d = spark.createDataFrame([(i, "s", 1.0) for i in range(6)], "id int, series string, v double")
    pairs = spark.createDataFrame([(0, 1, "s", "s", 2.0), (2, 3, "s", "s", 1.0)], "id_a int, id_b int, series_a string, series_b string, gap double")
    got = PL.mixed_quotas(d, "id", "series", [{"name": "p", "quota": 3, "pairs": pairs, "order": [F.negate("gap")]}], per_series=9)
    assert {r.id for r in got.collect()} == {0, 1}
