"""Contiguous shards of nearly equal bytes, from prefix sums over partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.common import shuffle_tasks, stage


def byte_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): one row per row of ``docs``.

    Rows are put in the order of (key, checksum, size), null keys first.  ``size`` is the UTF-8 bytes
    of the text plus 1; a row goes to the shard in whose equal share of all bytes its middle lies, so
    shards are contiguous and differ from the mean by one row's size at most.  ``slot`` counts the
    rows of a shard from 0.  A shard may be empty when one text is larger than a share.  Null and
    empty texts have size 1 and checksum 0; repeated rows get slots next to each other; an empty
    table gives no rows.  Only the two named columns are read.

    Texts are never shuffled: the narrow rows are range-partitioned (ties of a key are split by
    checksum and position), each partition is summed, and one small table with a row per partition
    carries the running totals.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    ranged = slim.withColumn("pos", F.monotonically_increasing_id()).repartitionByRange(shuffle_tasks(docs), *order, "pos")
    ranged = stage(ranged.sortWithinPartitions(*order, "pos").select(*order, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")))

    parts = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition, not per document
    parts = parts.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    run = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("upto", F.sum("size").over(run)).withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("pos")))
    placed = placed.join(parts, "part")
    at = F.expr(f"cast((2 * (bytes_before + upto) - size) * {int(shards)} div (2 * total) as int)")
    placed = placed.select(*order, F.least(at, F.lit(shards - 1)).alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("row"))
    starts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # at most ``shards`` rows
    out = placed.join(F.broadcast(starts), "shard")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
