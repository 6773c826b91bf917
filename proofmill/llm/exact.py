"""Exact duplicates: frequent digests are settled map-side, all others by an ordinary shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.arrowtext import utf8
from proofmill.llm.common import numbered, stage

COUNTERS = 1024


def normalised(text) -> F.Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def misra_gries(counters: dict, values: np.ndarray, counts: np.ndarray, most: int) -> None:
    """Add weighted values to at most ``most`` counters; each count is low by at most total / (most + 1)."""
    for v, c in zip(values.tolist(), counts.tolist()):
        counters[v] = counters.get(v, 0) + c
    while len(counters) > most:
        left = sorted(counters.values(), reverse=True)[most]
        for v in [v for v, c in counters.items() if c <= left]:
            del counters[v]
        for v in counters:
            counters[v] -= left


def _frequent(most: int):
    def run(batches):
        counters: dict = {}
        for batch in batches:
            buf, off, _ = utf8(batch.column(0))
            values, counts = np.unique(buf.reshape(-1, 32).view("V32").ravel() if len(buf) else np.zeros(0, "V32"), return_counts=True)
            for i in range(0, len(values), 4 * most):
                misra_gries(counters, values[i : i + 4 * most], counts[i : i + 4 * most], most)
        yield pa.RecordBatch.from_arrays([pa.array([bytes(v) for v in counters], pa.binary()), pa.array(list(counters.values()), pa.int64())], ["digest", "seen"])

    return run


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of ``docs``, dropped ones too.

    Texts are equal when identical after white-space runs become one space (SHA-256 of the UTF-8
    bytes); null counts as empty.  Of equal texts the row with the smallest key stays; rows without
    a key come last, and of rows that repeat key and text one stays.  ``keep_id`` is null where no row
    of the group has a key.  An empty table gives no rows.  Only the two named columns are read.

    A digest held by 2n / (counters + 1) rows or more is certain to be among the at most
    counters + 1 candidates that the merged Misra-Gries summaries leave; their true sizes and
    winners are computed with map-side sums and broadcast.  Every other group is smaller than that
    share, so the shuffle of the rest has no hot key.
    """
    src = docs.select(F.col(key).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"))
    out = _decided(stage(src.withColumn("row", F.monotonically_increasing_id())), counters)
    return out.select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def _decided(rows: DataFrame, counters: int) -> DataFrame:
    """``rows`` (doc_id, digest, row; stored) with ``first`` (unnamed, doc_id, row), the row that stays of their group, and ``group_size``."""
    seen = rows.select("digest").mapInArrow(_frequent(counters), "digest binary, seen long").groupBy("digest").agg(F.sum("seen").alias("seen"))
    total = rows.count()
    frequent = seen.where(F.col("seen") * (counters + 1) >= total).select("digest")  # at most counters + 1 rows
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("row"))).alias("first")
    settle = lambda df: df.groupBy("digest").agg(first, F.count(F.lit(1)).alias("group_size"))
    winners = stage(settle(rows.join(F.broadcast(frequent), "digest")))
    heavy = rows.join(F.broadcast(winners), "digest")
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    return heavy.unionByName(light.join(settle(light), "digest"))


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows that stay, with all columns of ``docs``; decided by row, so rows that repeat key and text are told apart."""
    rows, row = numbered(docs)
    src = rows.select(F.col(key).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"), F.col(row).alias("row"))
    gone = _decided(stage(src), counters).where("row <> first.row").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").drop(row)
