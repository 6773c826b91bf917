"""Repeated rows and missing values in the input tables."""

from pyspark.sql import functions as F

from proofmill.operators import pairs as PR
from proofmill.operators.selection import reason_panel
from proofmill.plans.bindings import Tables
from proofmill.plans.relations import directed_pairs, items


def test_panel_counts_a_repeated_key_once_and_puts_missing_sizes_last(spark):
    rows = [(f"k{i:02}", float(i), 1 if i % 2 else 2) for i in range(20) for _ in range(6)] + [("a", None, 2), ("b", None, 3)]
    d = spark.createDataFrame(rows, "key string, ae double, c int").repartition(3)
    got = reason_panel(d, "key", "ae", {"odd": F.col("c") == 1, "even": F.col("c") == 2, "none": F.col("c") == 3}, size=8).collect()
    assert {(r.key, r.reason) for r in got} == {("k19", "odd"), ("k18", "even"), ("b", "none"), *((f"k{i}", "largest_error") for i in (17, 16, 15, 14, 13))}


def tables(spark, parts, lines):
    t = Tables(spark, "none")
    t.__dict__["part"] = spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    t.__dict__["lineitem"] = spark.createDataFrame(
        [(p, p, 1, i, float(10 + i), 100.0 * (p + i), 0.02, 0.01 * i, "A") for i, p in enumerate(lines)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string",
    )
    return t


def test_items_of_a_repeated_part(spark):
    part = (1, "red oak", "B", "T", 5, 900.0)
    t = tables(spark, [part, part, (1, "red oak", "B", "T", 6, 900.0), (2, "tan oak", "B", "T", 5, 950.0)], [1, 1, 1, 2, 2])
    got = sorted((r.p_partkey, r.violations, r.n_exact) for r in items(t).collect())
    assert got == [(1, 1, 6), (1, 2, 3), (2, 1, 2)]


def test_directions_of_repeated_parts(spark):
    parts = [(1, "red oak", "B", "T", 5, 900.0), (1, "red oak", "B", "T", 5, 900.0), (1, "red elm", "B", "T", 5, 900.0), (2, "tan oak", "B", "T", 5, 950.0), (2, "tan oak", "B", "T", 5, 950.0), (2, "tan elm", "B", "T", 5, 950.0)]
    got = directed_pairs(tables(spark, parts, [1, 1, 2]))
    assert sorted((r.id_a, r.id_b) for r in got.collect()) == [(1, 2)] * 5  # four over oak, one over elm
    d = spark.createDataFrame([(r[0], r[1].split()[1], r[1].split()[0], r[5], 3) for r in parts], "id long, core string, fragment string, value double, core_size int")
    assert PR.matched_pairs(d).count() == 1


def test_permuted_rows_stay_where_their_places_are_counted(spark):
    from proofmill.operators.resample import permuted

    d = spark.createDataFrame([(i, [None, "a", "b"][i % 3], float(i)) for i in range(60)], "id int, k string, v double")
    p = permuted(d, "id", "v", within=["k"], replicates=2, seed=3)
    rows = p.collect()
    for rep in (1, 2):
        for k in (None, "a", "b"):
            own = {i for i in range(60) if [None, "a", "b"][i % 3] == k}
            assert {r.id for r in rows if r.rep == rep and r.k == k} == own == {int(r.permuted_v) for r in rows if r.rep == rep and r.k == k}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = permuted(d, "id", "v", within=["k"], replicates=2, seed=3)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") <= 10
