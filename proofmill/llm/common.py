"""Stages in the shared folder and small helpers of the operators here."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.session import stage_dir


def stage(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write the rows once to the shared folder and read them back; the files outlive lost executors."""
    path = f"{stage_dir(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows once in the shared folder with an id of their own, and the id's name: every later read sees the same ids.

    Keys may be null or repeated, so decisions about rows are carried back by this id.
    """
    name = free_name(df, "__row")
    return stage(df.withColumn(name, F.monotonically_increasing_id())), name


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows that go to a Python worker at once; texts reach from nothing to megabytes.
BATCH = 500


def small_batches(df: DataFrame, rows: int = BATCH) -> DataFrame:
    """``df``, after lowering the session's Arrow batch size to ``rows`` where it is larger."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name))
    if now <= 0 or now > rows:
        conf.set(name, str(rows))
    return df


def shuffle_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text) -> F.Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bit_table(tokens: DataFrame, column: str, bits: int = 22) -> bytes:
    """A packed table of 2**bits bits, set at the upper bits of each 64-bit value; at most 2**bits / 64 rows reach the driver."""
    at = F.shiftrightunsigned(column, 64 - bits)
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))")
    table = np.zeros(1 << (bits - 6), np.int64)
    for r in tokens.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(one).alias("b")).collect():
        table[r["w"]] = r["b"]
    return table.tobytes()


def unpack_bits(table: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(table, np.uint8), bitorder="little").view(bool)


#: Distinct labels that a sample is drawn for; more are no classes.
LABELS = 4096


def hash_sample(df: DataFrame, label: str, order: list, most: int) -> DataFrame:
    """At most ``most`` rows of each label, those with the least hash of ``order[0]``.

    Rows whose hash lies above what the label's number of rows leaves are let go where they are read, so
    about ``most`` rows of a label are moved and sorted, however many it has.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(LABELS + 1).collect()
    if len(sizes) > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    if not sizes:
        return df.limit(0)
    shares = F.create_map(*[F.lit(v) for r in sizes if r[0] is not None for v in (r[0], most * (1 + 6 / most**0.5) / r["n"])])
    place = F.pmod(F.xxhash64(order[0]), F.lit(1 << 30))
    few = df.where(place < shares[F.col(label)] * (1 << 30))
    nth = F.row_number().over(Window.partitionBy(label).orderBy(place, *order))
    return few.withColumn("__nth", nth).where(F.col("__nth") <= most).drop("__nth")
