"""Scans and sinks for measurement tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill.operators.gates import quarantine
from proofmill.session import cut_lineage


def read_csv(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """CSV with an explicit schema; a missing path is an empty table."""
    try:
        return spark.read.schema(schema).options(header=True, **options).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_inband_csv(
    spark: SparkSession, path, columns=None, *, tag: str, unit_row: str = "RESULT_UNIT", prefix: str = "RESULT_", allowed=None, file_pattern: str = r"(\d+)", id_from: str = "file_name"
) -> DataFrame:
    """Multi-file CSV whose files have their own headers and metadata rows; columns are united by name.

    Each file's header is the row whose first field is ``tag``.  Rows whose first field starts with
    ``prefix`` carry metadata; the unit row gives per-file units, kept as a ``units`` map (column ->
    unit, absent when the file has none).  ``columns`` defaults to all names found, in order; a column
    that a file lacks is null.  ``file_id`` is the first group of ``file_pattern`` in the file's name or path.
    """
    heads = spark.read.text(path).where(F.col("value").startswith(tag))
    width = heads.agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1
    fields = [f"_c{i}" for i in range(width)]
    raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in fields])).csv(path, header=False)
    raw = raw.select("_c0", F.array(*fields).alias("values"), F.col("_metadata.file_path").alias("__file"), F.regexp_extract(F.col(f"_metadata.{id_from}"), file_pattern, 1).alias("file_id"))
    if allowed is not None:
        raw = raw.where(F.col("file_id").isin(*allowed))
    heads = raw.where(F.col("_c0") == tag).groupBy("__file").agg(F.first("values").alias("heads"))
    # a column keeps its place though a header cell before it is empty; of repeated names the first column counts
    at = F.transform("heads", lambda x, i: F.struct(x.alias("name"), i.alias("at")))
    at = F.filter(at, lambda x: (F.coalesce(x["name"], F.lit("")) != "") & (F.array_position("heads", x["name"]) == x["at"] + 1))
    names = heads.select("__file", at.alias("places"), F.transform(at, lambda x: x["name"]).alias("names"))
    if columns is None:  # as many rows as there are column names
        found = names.select(F.posexplode("names").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at"))
        columns = [r["name"] for r in sorted(found.collect(), key=lambda r: (r["at"], r["name"]))]
    rows = raw.where(F.coalesce(F.col("_c0"), F.lit("")) != tag).join(names, "__file")
    rows = rows.withColumn("cells", F.map_from_arrays("names", F.transform("places", lambda x: F.col("values")[x["at"]])))
    head = F.coalesce(F.col("_c0").startswith(prefix), F.lit(False))
    units = rows.where(F.col("_c0") == unit_row).groupBy("__file").agg(F.first("cells").alias("cells"))
    units = units.select("__file", F.map_filter(F.transform_values("cells", lambda _, v: F.trim(v)), lambda k, v: (v != "") & (k != tag)).alias("units"))
    got = rows.where(~head).join(units, "__file", "left")
    return got.select(*[F.col("cells")[c].alias(c) for c in columns], "file_id", "units")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Multi-file TSV tagged with the file name and the hint before its first underscore."""
    d = spark.read.schema(schema).options(header=True, sep="\t").csv(path)
    name = F.col("_metadata.file_name")
    return d.withColumns({"source_file": name, "source_hint": F.element_at(F.split(name, "[_.]"), 1)})


def read_canonical(spark: SparkSession, root: str, names) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}


def write_processed(gated: DataFrame, summaries: dict, root: str) -> None:
    """Curated rows, quarantined rows and summaries as Parquet; arrays must already be text."""
    ok, bad = quarantine(cut_lineage(gated))  # written by both sides, so gated once
    ok.write.mode("overwrite").partitionBy("source").parquet(f"{root}/curated")
    bad.write.mode("overwrite").partitionBy("source").parquet(f"{root}/quarantine")
    for name, df in summaries.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def write_json(df: DataFrame, path: str) -> None:
    """One-file JSON for small summaries (findings summaries, manifests)."""
    df.coalesce(1).write.mode("overwrite").json(path)
