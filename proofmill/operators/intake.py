"""Intake of submitted measurement tables against registries, with the origin of every default."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.functions.text import blank_to_null, clean, join_flags
from proofmill.functions.values import RELATIONS, extract_relation, parse_numeric
from proofmill.operators.gates import conflicting_records, flag_record_conflicts
from proofmill.operators.ranking import null_safe_join
from proofmill.session import cut_lineage


def pseudonymizer(spark: SparkSession, key: bytes, namespace: str, prefix: str):
    """Keyed pseudonym function; the key travels as a broadcast and never enters a plan."""
    if len(key) < 16:
        raise ValueError("the pseudonym key must have at least 16 bytes")
    shared = spark.sparkContext.broadcast(key)

    @F.pandas_udf("string")
    def pseudonym(v: pd.Series) -> pd.Series:
        k = shared.value

        def one(x):
            if x is None or not str(x).strip():
                return None
            text = f"{namespace}\0{str(x).strip()}".encode()
            return f"{prefix}-{hmac.new(k, text, hashlib.sha256).hexdigest()[:20].upper()}"

        return v.map(one)

    return pseudonym


def with_origin(submitted: Column, registry: Column, configured: str | None) -> tuple[Column, Column]:
    """(value, origin): submitted, else registry, else configuration, else missing."""
    s, r = F.nullif(F.trim(submitted), F.lit("")), registry
    c = F.lit(configured)
    value = F.coalesce(s, r, c)
    origin = (
        F.when(s.isNotNull(), "submitted").when(r.isNotNull(), "registry").when(c.isNotNull(), "configuration").otherwise("missing")
    )
    return value, origin


def validate_intake(df: DataFrame, assays: DataFrame, units: DataFrame, *, endpoints, default_unit: str | None = None, latest_date: str | None = None) -> DataFrame:
    """Attach resolved unit/endpoint with origins, rejection codes and ``accepted``.

    ``df``: row_key, record_id, subject_id, structure, assay_code, endpoint, relation, result, unit, measured_on.
    ``assays``: assay_code, registry_endpoint, registry_unit.  ``units``: unit_text, factor.
    """
    d = df.join(assays.withColumn("__assay", F.lit(True)), "assay_code", "left")
    unit, unit_origin = with_origin(F.col("unit"), F.col("registry_unit"), default_unit)
    endpoint, endpoint_origin = with_origin(F.col("endpoint"), F.col("registry_endpoint"), None)
    d = d.withColumns({"unit_resolved": unit, "unit_origin": unit_origin, "endpoint_resolved": endpoint, "endpoint_origin": endpoint_origin})
    u = units.select(F.col("unit_text").alias("unit_resolved"), "factor")
    d = d.join(u, "unit_resolved", "left")
    d = d.withColumns({"value_numeric": parse_numeric("result"), "relation_resolved": extract_relation("result", "relation")})
    content = F.sha2(F.concat_ws("\0", *[clean(c) for c in ("record_id", "subject_id", "assay_code", "endpoint", "relation", "result", "unit")]), 256)
    # three grouped facts are read from this table, so it is stored once
    d = cut_lineage(d.withColumns({"__content": content, "source": F.lit("submission")}))
    firsts = d.groupBy("__content").agg(F.min("row_key").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    bad = conflicting_records(d, ("source", "record_id"), ("__content",), "record_id")
    ident = d.groupBy("subject_id").agg(F.min(blank_to_null("structure")).alias("__slo"), F.max(blank_to_null("structure")).alias("__shi"))
    ident = ident.where("__slo < __shi").select("subject_id", F.lit(True).alias("__sbad"))
    d = d.join(firsts, "__content", "left")
    d = flag_record_conflicts(d, keys=("source", "record_id"), conflicts=bad)
    d = null_safe_join(d, ident, ["subject_id"], "left")
    rules = [
        (clean("subject_id") == "", "missing_subject"),
        (clean("record_id") == "", "missing_record_id"),
        (F.col("__assay").isNull(), "unknown_assay"),
        (clean("result") == "", "missing_result"),
        ((clean("result") != "") & F.col("value_numeric").isNull(), "unparsed_result"),
        (F.col("value_numeric") <= 0, "nonpositive_result"),
        (F.col("unit_resolved").isNull(), "missing_unit"),
        (F.col("unit_resolved").isNotNull() & F.col("factor").isNull(), "unknown_unit"),
        (F.col("endpoint_resolved").isNull(), "missing_endpoint"),
        (F.col("endpoint_resolved").isNotNull() & ~F.col("endpoint_resolved").isin(*endpoints), "unknown_endpoint"),
        (~F.col("relation_resolved").isin(*RELATIONS), "invalid_relation"),
        (F.col("row_key") != F.col("__first"), "duplicate_record"),
        (F.col("record_conflict"), "source_row_id_conflict"),
        (F.col("__sbad"), "subject_structure_conflict"),
    ]
    if latest_date:
        rules.append((F.col("measured_on") > F.lit(latest_date).cast("date"), "future_date"))
    codes = join_flags(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in rules]))
    d = d.withColumn("rejection_codes", codes).withColumn("accepted", F.col("rejection_codes") == "")
    return d.drop("__content", "__first", "__assay", "__sbad", "record_conflict")
