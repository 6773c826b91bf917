"""Benchmark passages in documents: a prefix-filtered join on rare shingles, verified word by word.

A window is ``window`` consecutive item words (a shorter item is one window).  Containment of a whole
window asks for all of its shingles, so its rarest one is a sufficient prefix.  Rarity is counted over
all documents.  The scan of the documents is filtered by a bit table of fixed size, whatever the
benchmark's size; the surviving positions meet the prefix index in an ordinary join, where position
and length bounds come first and the words of the aligned window are compared last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.arrowtext import ALNUM, U64, chunks, shingle_hashes, utf8, word_hashes, word_spans
from proofmill.llm.common import bit_table, numbered, small_batches, stage, unpack_bits

#: The bit table has 2**BITS bits; false matches only cost work.
BITS = 22


def _hashed(buf, offsets):
    starts, ends, rows = word_spans(buf, offsets, ALNUM[0])
    return starts, ends, rows, word_hashes(buf, starts, ends, ALNUM[1])


def _text(raw: bytes, starts, ends, a: int, b: int) -> str:
    """Words a .. b-1, lower-cased, with single spaces."""
    return b" ".join([raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]).lower().decode("utf-8", "replace")


def _item_windows(window: int, k: int):
    """Rows (item, words, length, tokens) for every window of the items."""

    def run(batches):
        for batch in batches:
            buf, off, _ = utf8(batch.column(1))
            items = batch.column(0).to_pylist()
            for lo, hi in chunks(off):
                part = buf[off[lo] : off[hi]]
                starts, ends, rows, words = _hashed(part, off[lo : hi + 1] - off[lo])
                raw, grams = part.tobytes(), shingle_hashes(words, k)
                out = ([], [], [], [])
                for i in range(hi - lo):
                    a, b = int(rows[i]), int(rows[i + 1])
                    m = min(window, b - a)
                    for s in range(a, b - m + 1) if m else ():
                        out[0].append(items[lo + i])
                        out[1].append(_text(raw, starts, ends, s, s + m))
                        out[2].append(m)
                        out[3].append((grams[s : s + m - k + 1] if m >= k else shingle_hashes(words[s : s + m], m)).view(np.int64))
                for i in range(0, len(out[0]), 5000):
                    item, text, m, tokens = (x[i : i + 5000] for x in out)
                    yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(text, pa.string()), pa.array(m, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], ["item", "words", "length", "tokens"])

    return run


def _marked(table: np.ndarray, words: np.ndarray, rows: np.ndarray, lengths: tuple[int, ...]):
    """For each shingle length, the positions whose bit is set and that lie inside one row, with their hashes."""
    row_end = np.repeat(rows[1:], np.diff(rows)) if len(words) else np.zeros(0, np.int64)
    for k in lengths:
        grams = shingle_hashes(words, k)
        at = np.flatnonzero(table[grams >> U64(64 - BITS)])
        at = at[at + k <= row_end[at]]
        yield k, at, grams[at]


def _frequencies(bits: bytes, lengths: tuple[int, ...]):
    """Per chunk, how many rows have each marked shingle."""

    def run(batches):
        table = unpack_bits(bits)
        for batch in batches:
            buf, off, _ = utf8(batch.column(0))
            for lo, hi in chunks(off):
                _, _, rows, words = _hashed(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                for _, at, grams in _marked(table, words, rows, lengths):
                    owner = np.searchsorted(rows, at, "right").astype(U64)
                    pairs = np.unique(np.stack([grams, owner], 1), axis=0) if len(at) else np.zeros((0, 2), U64)
                    token, n = np.unique(pairs[:, 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n, pa.int64())], ["token", "n"])

    return run


def _candidates(bits: bytes, lengths: tuple[int, ...], window: int):
    """Per row its number of words and the marked positions, each with the words that a window over it can use."""

    def run(batches):
        table = unpack_bits(bits)
        for batch in batches:
            buf, off, _ = utf8(batch.column(1))
            for lo, hi in chunks(off):
                part = buf[off[lo] : off[hi]]
                starts, ends, rows, words = _hashed(part, off[lo : hi + 1] - off[lo])
                raw, found = part.tobytes(), []
                for k, at, grams in _marked(table, words, rows, lengths):
                    owner = np.searchsorted(rows, at, "right") - 1
                    for r, p, g in zip(owner.tolist(), at.tolist(), grams.view(np.int64).tolist()):
                        first, end = int(rows[r]), int(rows[r + 1])
                        base = max(first, p - window + k)
                        found.append((r, {"token": g, "pos": p - first, "base": base - first, "context": _text(raw, starts, ends, base, min(end, p + window))}))
                found.sort(key=lambda x: x[0])
                at = np.searchsorted(np.array([x[0] for x in found], np.int64), np.arange(hi - lo + 1)).astype(np.int32)
                kind = pa.struct([("token", pa.int64()), ("pos", pa.int64()), ("base", pa.int64()), ("context", pa.string())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(rows), pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array([x[1] for x in found], kind))], ["doc_id", "n_words", "marks"]
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, k: int = 3) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): one row per row of ``docs``.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.  ``n_hit`` counts
    the document words inside any occurrence of an item window; ``n_items`` the items (distinct
    non-null ids) with an occurring window; the digest is over their ids, sorted as strings and
    joined by commas.  Null and empty texts have no words; an item without words has no window; an
    empty benchmark gives zero hits; repeated rows are counted one by one.  Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    src = small_batches(docs).select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    bench = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    made = stage(bench.mapInArrow(_item_windows(window, k), "item string, words string, length int, tokens array<long>"))
    windows = made.groupBy("words").agg(F.first("length").alias("length"), F.first("tokens").alias("tokens"))
    spread = windows.select("words", "length", F.posexplode("tokens").alias("offset", "token"))
    lengths = tuple(sorted(r[0] for r in windows.select(F.least("length", F.lit(k))).distinct().collect())) or (k,)  # at most k numbers

    # rarity over all documents, then the rarest shingle of each window; one that occurs nowhere ends the window
    tokens = spread.select("token").distinct()
    seen = src.select("text").mapInArrow(_frequencies(bit_table(tokens, "token", BITS), lengths), "token long, n long")
    rarity = seen.groupBy("token").agg(F.sum("n").alias("df")).join(tokens, "token", "left_semi")
    rarest = F.min(F.struct("df", "token", "offset")).alias("r")
    index = spread.join(rarity, "token", "left").withColumn("df", F.coalesce("df", F.lit(0))).groupBy("words", "length").agg(rarest)
    index = stage(index.where("r.df > 0").select("words", "length", "r.token", "r.offset"))

    bits = bit_table(index, "token", BITS)
    rows = src.mapInArrow(_candidates(bits, lengths, window), f"doc_id {kind}, n_words long, marks array<struct<token: long, pos: long, base: long, context: string>>")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()))
    marks = rows.where(F.size("marks") > 0).select("row", "n_words", F.explode("marks").alias("m")).select("row", "n_words", "m.*")
    start = F.col("pos") - F.col("offset")
    bounds = (F.col("length") <= F.col("n_words")) & (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    met = marks.join(index, "token").where(bounds).withColumn("start", start)
    same = F.slice(F.split("context", " "), (F.col("start") - F.col("base") + 1).cast("int"), F.col("length")) == F.split("words", " ")
    hits = stage(met.where(F.when(F.col("start") >= F.col("base"), same).otherwise(False)).select("row", "start", (F.col("start") + F.col("length")).alias("end"), "words"))

    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    cover = hits.select("row", "start", "end").distinct().withColumn("done", F.coalesce(F.max("end").over(before), F.lit(0)))
    cover = cover.groupBy("row").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "done"), F.lit(0))).alias("n_hit"))
    owners = made.where("item is not null").select("words", "item").distinct()
    items = hits.select("row", "words").distinct().join(owners, "words").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.select("row", "doc_id", "n_words").join(cover, "row", "left").join(items, "row", "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without any hit, all columns; each row is judged by itself, whatever its key."""
    rows, row = numbered(docs)
    bad = contamination(rows, benchmark, row, text, **how).where("contaminated").select(F.col("doc_id").alias(row))
    return rows.join(bad, row, "left_anti").drop(row)
