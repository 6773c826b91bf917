"""Readers and writers, each checked by writing a table and reading it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill.operators import contracts as C
from proofmill.plans.registry import query
from proofmill.session import stage_dir
from proofmill.sources import tables as TB


def folder(t) -> str:
    return f"{stage_dir(t.spark).rstrip('/')}/round-trip-{uuid.uuid4().hex}"


@query("csv_round_trip", "select n_nationkey, n_name, n_regionkey from nation")
def csv_round_trip(t):
    """Written with a header and read under an explicit schema; a missing path adds nothing."""
    path, schema = folder(t), t.nation.schema
    t.nation.write.option("header", True).csv(path)
    return TB.read_csv(t.spark, path, schema).unionByName(TB.read_csv(t.spark, f"{path}-missing", schema))


@query("inband_csv_union", """
select s_suppkey::varchar as "SID", case when s_suppkey%2=0 then s_name end as "Name", s_nationkey::varchar as "Value", case when s_suppkey%2=0 then '12' else '11' end as file_id, case when s_suppkey%2=1 then 'uM' end as unit from supplier
""")
def inband_csv_union(t):
    """Two files with different headers; only the first states a unit."""
    path = folder(t)
    s = t.supplier
    even, odd = F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 2 == 1

    def put(name, lines, rows):
        text = t.spark.createDataFrame([(x,) for x in lines], "value string")
        text.union(rows).coalesce(1).write.text(f"{path}/{name}")

    put("aid_11", ["TAG,SID,Value", "RESULT_TYPE,,FLOAT", "RESULT_UNIT,,uM"], s.where(odd).select(F.concat_ws(",", F.lit("1"), "s_suppkey", "s_nationkey")))
    put("aid_12", ["TAG,SID,Name,Value", "RESULT_TYPE,,,FLOAT"], s.where(even).select(F.concat_ws(",", F.lit("1"), "s_suppkey", "s_name", "s_nationkey")))
    d = TB.read_inband_csv(t.spark, [f"{path}/aid_11", f"{path}/aid_12"], tag="TAG", file_pattern=r"aid_(\d+)", id_from="file_path")
    return d.select("SID", "Name", "Value", "file_id", F.col("units")["Value"].alias("unit"))


@query("tsv_round_trip", "select r_regionkey, r_name, true as tagged from region")
def tsv_round_trip(t):
    path = folder(t)
    t.region.write.option("header", True).option("sep", "\t").csv(path)
    d = TB.read_tsv(t.spark, path, t.region.schema)
    return d.select("r_regionkey", "r_name", (F.col("source_file").startswith("part") & F.col("source_hint").startswith("part")).alias("tagged"))


@query("canonical_round_trip", "select 'part' as \"table\", count(*) as n_rows, sum(p_size)::bigint as total from part union all select 'supplier', count(*), sum(s_nationkey)::bigint from supplier")
def canonical_round_trip(t):
    path = folder(t)
    t.part.write.parquet(f"{path}/part")
    t.supplier.write.parquet(f"{path}/supplier")
    got = TB.read_canonical(t.spark, path, ["part", "supplier"])
    one = lambda n, c: got[n].agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("n_rows"), F.sum(c).cast("long").alias("total"))
    return one("part", "p_size").unionByName(one("supplier", "s_nationkey"))


@query("processed_round_trip", "select case when is_eligible then 'curated' else 'quarantine' end as side, source, count(*) as n from @gated group by 1,2")
def processed_round_trip(t):
    path = folder(t)
    TB.write_processed(t.gated.select("row_key", "source", "is_eligible", "exclusion_reason"), {}, path)
    sides = [t.spark.read.parquet(f"{path}/{s}").groupBy(F.lit(s).alias("side"), "source").agg(F.count(F.lit(1)).alias("n")) for s in ("curated", "quarantine")]
    return sides[0].unionByName(sides[1])


CUSTOMERS = C.Contract(
    "customers",
    (C.Field("c_custkey", T.LongType()), C.Field("c_name", T.StringType()), C.Field("c_acctbal", T.DoubleType()), C.Field("c_mktsegment", T.StringType())),
    key=("c_custkey",),
)


@query("contract_round_trip", "select c_custkey, c_name, c_acctbal, c_mktsegment from customer")
def contract_round_trip(t):
    path = folder(t)
    C.write_table(t.customer.select("c_mktsegment", "c_custkey", "c_name", "c_acctbal"), CUSTOMERS, path)
    return t.spark.read.parquet(path)


@query("json_round_trip", "select o_orderstatus, count(*) as n, round(sum(o_totalprice),2) as total from orders group by 1")
def json_round_trip(t):
    path = folder(t)
    g = t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    TB.write_json(g, path)
    return t.spark.read.schema(g.schema).json(path)
