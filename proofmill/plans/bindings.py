"""Views over the driver tables, written once for Spark and once as SQL text."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.plans.registry import VIEWS
from proofmill.session import cut_lineage

SOURCE_PRIORITY = ("alpha", "beta", "gamma")
ENDPOINTS = {"1URGENT": "urgent", "2HIGH": "high", "3MEDIUM": "medium", "5LOW": "low"}
STAGE_COLUMNS = (
    "row_key", "subject_id", "source", "endpoint", "family", "relation", "yr", "value_scaled", "p_value",
    "is_exact", "is_censored", "is_core_endpoint", "is_eligible", "exclusion_reason",
)
CORE_ENDPOINTS = ("urgent", "high", "medium", "low")


class Tables:
    """Lazy access to base tables and the derived evidence views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        self.__dict__[name] = df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return df

    @cached_property
    def raw(self) -> DataFrame:
        li = self.lineitem.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate"
        )
        od = self.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
        j = li.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
        v = (F.ceil(F.col("l_quantity") / 10) * 10).cast("int")
        text = v.cast("string")
        s13 = F.col("l_suppkey") % 13
        return j.select(
            F.concat(F.lit("S"), F.col("l_partkey")).alias("subject_id"),
            F.when(F.col("l_returnflag") == "A", "alpha")
            .when(F.col("l_returnflag") == "N", "beta")
            .otherwise("gamma")
            .alias("source"),
            F.col("o_orderpriority").alias("endpoint"),
            F.col("o_orderstatus").alias("family"),
            F.when(F.col("l_linenumber") == 1, "<")
            .when(F.col("l_linenumber") == 2, ">")
            .when(F.col("l_linenumber") == 3, "~")
            .when(F.col("l_linenumber") == 4, "")
            .when(F.col("l_linenumber") == 5, "≤")
            .otherwise("=")
            .alias("relation"),
            F.when(s13 == 0, "not reported")
            .when(s13 == 1, F.concat(F.lit(">"), text, F.lit(" nM")))
            .when(s13 == 2, F.concat(F.lit("1,0"), text))
            .when(s13 == 3, F.concat(text, F.lit("-"), (v + 20).cast("string")))
            .when(s13 == 4, F.concat(F.lit("-"), text))
            .otherwise(text)
            .alias("value_text"),
            F.element_at(
                F.array(*map(F.lit, ["nM", "nmol/L", "nM", "uM", "µM", "µM", "mg/mL", ""])),
                (F.col("l_suppkey") % 8 + 1).cast("int"),
            ).alias("unit"),
            F.concat_ws(":", "l_orderkey", "l_linenumber").alias("record_id"),
            F.concat(F.lit("A"), (F.col("l_suppkey") % 20).cast("string")).alias("assay_id"),
            F.concat(F.lit("D"), F.col("l_suppkey")).alias("document_id"),
            F.year("l_shipdate").alias("yr"),
            F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"),
        )

    @cached_property
    def normalized(self) -> DataFrame:
        from proofmill.operators.gates import normalize_values

        return normalize_values(self.raw, endpoint_names=ENDPOINTS)

    @cached_property
    def value_cuts(self) -> list[float]:
        """Balancing cut points of the value axis, from one column of the scan."""
        from proofmill.operators.ranking import cut_points

        return cut_points(self.lineitem.select(F.col("l_quantity")), "l_quantity")

    @cached_property
    def gated(self) -> DataFrame:
        from proofmill.operators.gates import IDENTITY, gate

        # the gate stores what it gets, so it gets what its identities, its rules and the queries read
        keep = [c for c in STAGE_COLUMNS if c not in ("is_core_endpoint", "is_eligible", "exclusion_reason")]
        return gate(self.normalized.select(*dict.fromkeys((*keep, *IDENTITY, "unit_status"))), core_endpoints=CORE_ENDPOINTS)

    @cached_property
    def mirrored(self) -> DataFrame:
        from proofmill.operators.gates import link_mirrors

        # the gated table is a stage boundary: linking and aggregation read it several times
        return link_mirrors(cut_lineage(self.gated.select(*STAGE_COLUMNS)), priority=SOURCE_PRIORITY)

    @cached_property
    def measured(self) -> DataFrame:
        """Stored value columns for operators that read the normalised table several times."""
        keep = [c for c in STAGE_COLUMNS if c not in ("is_core_endpoint", "is_eligible", "exclusion_reason")]
        return cut_lineage(self.normalized.select(*keep, "document_id"))

    @cached_property
    def predictions(self) -> DataFrame:
        """row_id, subject, grp, fold, model, observed, predicted, lower, upper, sigma."""
        li = self.lineitem
        obs = F.log10(F.col("l_extendedprice"))
        base = F.log10(F.col("l_quantity") * 3000)
        return li.select(
            F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
            F.concat(F.lit("S"), F.col("l_partkey")).alias("subject"),
            F.concat(F.lit("G"), F.col("l_suppkey")).alias("grp"),
            (F.col("l_orderkey") % 5).cast("int").alias("fold"),
            F.round(obs, 4).alias("observed"),
            F.round(base, 4).alias("predicted"),
            F.round(base * 0.9 + F.col("l_tax") * 5, 4).alias("baseline"),
            (F.col("l_tax") + 0.05).alias("sigma"),
            F.col("l_returnflag").alias("stratum"),
        )

    @cached_property
    def scores(self) -> DataFrame:
        """doc_id, label (0/1), score in (0, 1), grp."""
        from proofmill.functions.draws import hash_int

        d = self.documents.select("doc_id", "n_chars", "source", "lang")
        u = hash_int(F.lit("s"), F.col("doc_id")) % 1000 / F.lit(2000.0)
        return self.labels.join(d, "doc_id").select(
            "doc_id",
            F.col("quality").alias("label"),
            F.round(u + F.col("quality") * 0.3 + 0.05, 4).alias("score"),
            F.round(u * 0.8 + F.col("quality") * 0.2 + 0.1, 4).alias("score_b"),
            "toxic",
            F.col("source").alias("grp"),
            "lang",
        )


VIEWS["raw"] = """
select 'S'||l_partkey as subject_id,
 case l_returnflag when 'A' then 'alpha' when 'N' then 'beta' else 'gamma' end as source,
 o_orderpriority as endpoint, o_orderstatus as family,
 case l_linenumber when 1 then '<' when 2 then '>' when 3 then '~' when 4 then '' when 5 then '≤' else '=' end as relation,
 case l_suppkey%13 when 0 then 'not reported' when 1 then '>'||v||' nM' when 2 then '1,0'||v
   when 3 then v||'-'||(v+20) when 4 then '-'||v else v::varchar end as value_text,
 case l_suppkey%8 when 0 then 'nM' when 1 then 'nmol/L' when 2 then 'nM' when 3 then 'uM' when 4 then 'µM' when 5 then 'µM'
   when 6 then 'mg/mL' else '' end as unit,
 l_orderkey||':'||l_linenumber as record_id, 'A'||(l_suppkey%20) as assay_id, 'D'||l_suppkey as document_id,
 year(l_shipdate) as yr, l_orderkey||':'||l_linenumber||':'||l_partkey||':'||l_suppkey as row_key
from (select *, cast(ceil(l_quantity/10)*10 as int) as v from lineitem) join orders on o_orderkey=l_orderkey
"""
VIEWS["normalized"] = """
select *, value_numeric*factor as value_scaled0,
 case when value_numeric*factor>0 then value_numeric*factor end as value_scaled,
 case when value_numeric*factor>0 then 9-log10(value_numeric*factor) end as p_value,
 case when unit_normalized='' then 'missing_unit' when factor is not null then 'converted' else 'unsupported_unit' end as unit_status
from (select *, case unit_normalized when 'nm' then 1.0::double when 'nmol/l' then 1.0 when 'um' then 1000.0 end as factor
 from (select subject_id, source, family, value_text, unit, record_id, assay_id, document_id, yr, row_key,
  case endpoint when '1-URGENT' then 'urgent' when '2-HIGH' then 'high' when '3-MEDIUM' then 'medium' when '5-LOW' then 'low' else endpoint end as endpoint,
  case when relation='≤' then '<=' when relation<>'' then relation
   when value_text like '>%' then '>' else '=' end as relation,
  try_cast(nullif(regexp_extract(replace(value_text,',',''),'[-+]?[0-9]*\\.?[0-9]+',0),'') as double) as value_numeric,
  lower(replace(unit,'µ','u')) as unit_normalized
  from @raw))
""".replace("\\\\", "\\")
VIEWS["predictions"] = """
select l_orderkey||':'||l_linenumber||':'||l_partkey||':'||l_suppkey as row_id, 'S'||l_partkey as subject, 'G'||l_suppkey as grp,
 (l_orderkey%5)::int as fold, round(log10(l_extendedprice),4) as observed, round(log10(l_quantity*3000),4) as predicted,
 round(log10(l_quantity*3000)*0.9+l_tax*5,4) as baseline, l_tax+0.05 as sigma, l_returnflag as stratum from lineitem
"""
VIEWS["scores"] = """
select doc_id, quality as label, round(u+quality*0.3+0.05,4) as score, round(u*0.8+quality*0.2+0.1,4) as score_b, toxic, source as grp, lang
from (select l.*, d.source, d.lang, (('0x'||substr(md5('s:'||l.doc_id),1,8))::bigint%1000)/2000.0::double as u
 from labels l join documents d using(doc_id))
"""
