import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmill.operators import splitplan as SP


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"S{i // 2}", f"G{i // 10}", i % 2, 2000 + i % 17 if i % 5 else None, i) for i in range(400)]
    return spark.createDataFrame(data, "subject string, grp string, y int, year int, i int").repartition(4)


def test_random_plan_is_repeatable_and_holds_both_classes(rows):
    a, ra = SP.split_plan(rows, "random", "subject", label="y", seed=7)
    b, rb = SP.split_plan(rows.repartition(7), "random", "subject", label="y", seed=7)
    assert ra == rb and ra.identity_overlap == 0 and ra.fallback_reason is None
    assert {r.i for r in a.where("role = 'test'").collect()} == {r.i for r in b.where("role = 'test'").collect()}
    assert {r.y for r in a.where("role = 'test'").select("y").distinct().collect()} == {0, 1}
    assert abs(ra.n_test / ra.n_rows - 0.2) < 0.05


def test_groups_and_identities_stay_on_one_side(rows):
    out, r = SP.split_plan(rows, "group", "subject", group="grp", label="y")
    assert r.strategy == "group" and r.identity_overlap == 0
    assert out.groupBy("grp").agg(F.count_distinct("role").alias("n")).where("n > 1").count() == 0


def test_time_plan_tests_the_latest(rows):
    out, r = SP.split_plan(rows, "temporal", "subject", label="y", year="year")
    first = {}
    for x in rows.collect():
        if x.year is not None:
            first[x.subject] = min(first.get(x.subject, x.year), x.year)
    for x in out.collect():
        assert (x.role == "test") == (first.get(x.subject, 0) >= r.cutoff)


@pytest.mark.parametrize(
    "how, columns, reason",
    [("temporal", {}, "no time column"), ("temporal", {"year": "none"}, "too few dated rows"), ("temporal", {"year": "same"}, "two years are needed"), ("group", {}, "no group column"), ("group", {"group": "same"}, "a group holdout needs two groups")],
)
def test_what_cannot_be_done_is_recorded(rows, how, columns, reason):
    d = rows.withColumns({"none": F.lit(None).cast("int"), "same": F.lit(1)})
    _, r = SP.split_plan(d, how, "subject", label="y", **columns)
    assert (r.requested, r.strategy, r.fallback_reason) == (how, "random", reason)
    assert r.identity_overlap == 0 and r.n_test > 0


def test_too_small_tables_are_refused(rows):
    with pytest.raises(ValueError):
        SP.split_plan(rows.limit(3), "random", "subject")
    with pytest.raises(ValueError):
        SP.split_plan(rows, "sideways", "subject")


def test_every_fold_has_its_share_of_every_class(spark):
    r = np.random.default_rng(1)
    data = [(f"g{g}", "rare" if r.random() < 0.08 else "b" if r.random() < 0.4 else "c") for g in range(90) for _ in range(1 + g % 5)]
    df = spark.createDataFrame([(g, y) for g, y in data] + [("g1", None)], "g string, y string")
    dealt, record = SP.stratified_folds(df, "g", "y", 4)
    assert record["folds"] == 4 and record["classes"][0] == "rare"
    got = {x.g: x for x in dealt.collect()}
    assert sum(x.n for x in got.values()) == len(data) and len(got) == len({g for g, _ in data})
    for i, v in enumerate(record["classes"]):
        want = sum(y == v for _, y in data)
        per = [sum(x[f"c{i}"] for x in got.values() if x.fold == f) for f in range(4)]
        assert sum(per) == want and max(per) - min(per) <= max(2, want // 8)


def test_folds_fall_to_what_the_rarest_class_allows(spark):
    df = spark.createDataFrame([(f"g{i}", int(i < 3)) for i in range(40)], "g string, y int")
    dealt, record = SP.stratified_folds(df, "g", "y", 5)
    assert record["folds"] == 3 and record["fallback_reason"]
    assert dealt.groupBy("fold").agg(F.sum("c0").alias("n")).where("n = 0").count() == 0
    with pytest.raises(ValueError):
        SP.stratified_folds(spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("c", 0)], "g string, y int"), "g", "y", 3)


def test_leave_one_group_out_against_numpy(spark):
    r = np.random.default_rng(2)
    x, g = r.normal(size=(120, 2)) * [1, 9], r.integers(0, 6, 120)
    y = x @ [1.5, -0.2] + r.normal(size=120) + g
    df = spark.createDataFrame([(int(k), float(a), float(b), float(v)) for k, (a, b), v in zip(g, x, y)], "g int, a double, b double, y double")
    for row in SP.leave_group_out_ridge(df, "g", ["a", "b"], "y", 10.0).collect():
        train = g != row.g
        mean, sd = x[train].mean(0), x[train].std(0)
        z = (x[train] - mean) / sd
        w = np.linalg.solve(z.T @ z + 10.0 * np.eye(2), z.T @ (y[train] - y[train].mean()))
        assert row.train_mean == pytest.approx(y[train].mean())
        assert row.ridge == pytest.approx(y[train].mean() + ((np.array([row.a, row.b]) - mean) / sd) @ w)
    alone = SP.leave_group_out_ridge(df.where("g = 0"), "g", ["a", "b"], "y", 10.0)
    assert alone.where("ridge is not null").count() == 0
