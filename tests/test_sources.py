import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill.functions import values as V
from proofmill.operators import audits as AU
from proofmill.operators import contracts as C
from proofmill.operators import intake as IN
from proofmill.sources import manifest as MF
from proofmill.sources import tables as TB

S = T.StringType()


def test_inband_csv_units_and_missing_unit_row(spark, tmp_path):
    (tmp_path / "aid_11.csv").write_text("TAG,SID,Value\nRESULT_TYPE,,FLOAT\nRESULT_UNIT,,uM\n1,5,2.5\n")
    (tmp_path / "aid_12.csv").write_text("TAG,SID,Value\nRESULT_TYPE,,FLOAT\n1,6,7\n")
    d = TB.read_inband_csv(spark, str(tmp_path), ["TAG", "SID", "Value"], tag="TAG")
    got = {r.file_id: (r.Value, (r.units or {}).get("Value")) for r in d.collect()}
    assert got == {"11": ("2.5", "uM"), "12": ("7", None)}
    assert TB.read_inband_csv(spark, str(tmp_path), ["TAG", "SID", "Value"], tag="TAG", allowed=["12"]).count() == 1
    # another file with other columns: united by name
    (tmp_path / "aid_13.csv").write_text('TAG,Other,SID\nRESULT_UNIT,nM,\n1,"a,b",8\n')
    d = TB.read_inband_csv(spark, str(tmp_path), tag="TAG")
    assert set(d.columns) == {"TAG", "SID", "Value", "Other", "file_id", "units"}
    got = {r.file_id: (r.SID, r.Value, r.Other, r.units) for r in d.collect()}
    assert got == {"11": ("5", "2.5", None, {"Value": "uM"}), "12": ("6", "7", None, None), "13": ("8", None, "a,b", {"Other": "nM"})}


def test_an_empty_header_cell_does_not_shift_the_columns_after_it(spark, tmp_path):
    (tmp_path / "aid_21.csv").write_text("TAG,,SID,Value,SID\nRESULT_UNIT,x,,uM,\n1,gone,5,2.5,again\n")
    r = TB.read_inband_csv(spark, str(tmp_path), tag="TAG").first()
    assert (r.TAG, r.SID, r.Value, r.units) == ("1", "5", "2.5", {"Value": "uM"})


def test_missing_csv_is_empty_and_tsv_is_tagged(spark, tmp_path):
    sch = T.StructType([T.StructField("a", S)])
    assert TB.read_csv(spark, str(tmp_path / "none.csv"), sch).count() == 0
    (tmp_path / "hint_x.tsv").write_text("a\nv\n")
    r = TB.read_tsv(spark, str(tmp_path / "hint_x.tsv"), sch).first()
    assert (r.a, r.source_hint) == ("v", "hint")


def test_manifest_detects_tampering(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.txt").write_text(n)
    inv = spark.createDataFrame(MF.file_inventory(spark, str(tmp_path)).collect())
    digest = MF.manifest_digest(inv)
    assert MF.verify_chain([{"name": "s", "digest": digest, "upstream": "", "inventory": inv}]) == []
    (tmp_path / "a.txt").write_text("b")
    os.remove(tmp_path / "b.txt")
    (tmp_path / "d.txt").write_text("dd")
    now = MF.file_inventory(spark, str(tmp_path))
    assert {r.path: r.status for r in MF.verify(inv, now).collect()} == {"a.txt": "sha256_mismatch", "b.txt": "missing", "c.txt": "ok", "d.txt": "extra"}
    assert MF.manifest_digest(now) != digest


def test_contract(spark, tmp_path):
    k = C.Contract("t", (C.Field("id", S), C.Field("v", T.DoubleType(), low=0.0), C.Field("u", S, required=False, enum=("a", "b"))), key=("id",), checks={"v_for_a": "u <> 'a' or v > 1"})
    ok = spark.createDataFrame([("1", 2.0, "a"), ("2", 0.5, None)], k.schema())
    C.write_table(ok, k, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    bad = spark.createDataFrame([("1", -1.0, "a"), ("1", float("nan"), "z")], "id string, v double, u string")
    got = {r.rule: r.n_rows for r in C.violations(bad, k).collect()}
    assert got["min:v"] == 1 and got["enum:u"] == 1 and got["primary_key"] == 2 and got["check:v_for_a"] == 1 and got["finite:v"] == 1
    with pytest.raises(C.ContractError):
        C.validate(ok.withColumn("extra", F.lit(1)), k)


def test_pseudonyms_and_roles(spark):
    d = spark.createDataFrame([("a",), ("a ",), ("b",), (None,)], "s string")
    f = IN.pseudonymizer(spark, b"0123456789abcdef", "ns", "P")
    got = [r.p for r in d.select(f("s").alias("p")).collect()]
    assert got[0] == got[1] != got[2] and got[3] is None
    with pytest.raises(ValueError):
        IN.pseudonymizer(spark, b"short", "ns", "P")
    with pytest.raises(AU.LeakageError):
        AU.require_roles(spark.createDataFrame([("train",), ("locked",)], "r string"), "r", ("train",))


def test_row_local_parsing_accepts_a_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([("<5",), ("7 nM",)], "v string").write.parquet(str(src))
    st = V.with_qualified(spark.readStream.schema("v string").parquet(str(src)), "v", "q")
    q = st.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(out))
    q.awaitTermination(60)
    assert {(r.q.relation, r.q.value) for r in spark.read.parquet(str(out)).collect()} == {("<", 5.0), ("=", 7.0)}


def test_every_query_has_a_name_and_sql_expands():
    import __spark_entry__ as e

    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) > 150 and all("@" not in s for s in sql.values())
