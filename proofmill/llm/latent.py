"""Text quality by a vote of the nearest labelled documents in a latent-semantic space.

Terms are hashed n-grams of character shapes (letters, capitals, digits, and each mark as itself), hashed
words, and hashed pairs of words.  Their document frequencies cover all documents; a bounded labelled sample gives the latent space
and the labelled vectors.  Every document is scored by exact cosine products with all of them, block
by block, and its nearest neighbours vote with weights that grow with similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill.llm.arrowtext import SPACED, U64, chunks, mix, utf8, word_hashes, word_spans
from proofmill.llm.bytecnn import hashed_remainder
from proofmill.llm.common import free_name, hash_sample, small_batches

#: Hashed terms of each kind (shapes; words and their pairs), length of a shape, latent axes.
KIND, GRAM, RANK = 4096, 4, 32
TERMS = 2 * KIND
#: Length of the word part of a document's vector; that of the shape part is 1.
WORDS = 0.5
#: Texts whose terms a task holds at a time.
STEP = 64
#: At most this many labelled rows of each label are learned from.
SAMPLE, NEIGHBOURS, SHARPNESS = 800, 15, 4


def _shapes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    out[128:] = ord("a")
    out[ord("a") : ord("z") + 1] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    return out


SHAPES = _shapes()


def term_counts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by terms: how often each hashed shape n-gram, and each hashed word or pair of words, occurs."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.int64)
    ends = len(buf) - GRAM + 1
    if ends > 0:
        shape = SHAPES[buf]
        h = np.zeros(ends, np.uint32)
        for i in range(GRAM):
            h = (h + shape[i : i + ends]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        row = np.repeat(np.arange(n), np.diff(offsets))[:ends]
        inside = np.arange(ends) + GRAM <= offsets[1:][row]
        out[:, :KIND] = np.bincount(row[inside] * KIND + (h[inside] % KIND), minlength=n * KIND).reshape(n, KIND)
    starts, stops, rows = word_spans(buf, offsets, SPACED[0])
    if len(starts):
        words = word_hashes(buf, starts, stops, SPACED[1])
        row = np.repeat(np.arange(n), np.diff(rows))
        pairs = np.flatnonzero(row[1:] == row[:-1])
        h = np.concatenate([words, mix(words[pairs] ^ (words[pairs + 1] * U64(3)))])
        row = np.concatenate([row, row[pairs]])
        out[:, KIND:] = np.bincount(row * KIND + (h >> U64(52)).astype(np.int64) % KIND, minlength=n * KIND).reshape(n, KIND)
    return out


def unit_parts(x: np.ndarray) -> np.ndarray:
    """Each row's shape part at length 1 and its word part at length WORDS; a part without terms stays 0."""
    for part, length in ((x[:, :KIND], 1.0), (x[:, KIND:], WORDS)):
        part *= length / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return x


def _frequencies(batches):
    total = np.zeros(TERMS + 1, np.int64)
    for batch in batches:
        buf, off, _ = utf8(batch.column(0))
        for lo, hi in chunks(off):
            for a in range(lo, hi, STEP):
                b = min(hi, a + STEP)
                total[:TERMS] += (term_counts(buf[off[a] : off[b]], off[a : b + 1] - off[a]) > 0).sum(0)
        total[TERMS] += batch.num_rows
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["term", "n"])


def _sparse(batches):
    for batch in batches:
        buf, off, _ = utf8(batch.column(1))
        for lo, hi in chunks(off):
            terms, counts = [], []
            for i in range(lo, hi):
                c = term_counts(buf[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))[0]
                at = np.flatnonzero(c)
                terms.append(at.tolist())
                counts.append(c[at].tolist())
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(terms, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], ["label", "terms", "counts"])


@dataclass
class LatentVote:
    """Inverse document frequencies, projection, labelled unit vectors, their votes, and the share of label 1."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors; zero for a row without terms."""
        x = np.zeros(counts.shape, np.float32)
        r, c = np.nonzero(counts)
        x[r, c] = (1 + np.log(counts[r, c])) * self.idf[c]
        z = unit_parts(x) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        z = self.project(counts)
        if not len(self.vectors):
            return np.full(len(z), self.prior)
        cosine = np.round((z @ self.vectors.T).astype(np.float64), 6)
        k = min(NEIGHBOURS, cosine.shape[1])
        last = np.partition(cosine, -k, axis=1)[:, -k, None]
        near, tied = cosine > last, cosine == last
        near |= tied & (np.cumsum(tied, 1) <= k - near.sum(1, keepdims=True))  # of equal cosines the first labelled rows
        w = np.where(near, np.maximum(cosine, 0) ** SHARPNESS * self.weights, 0)
        total = w.sum(1)
        vote = w @ self.labels
        return np.where(total > 0, np.clip(vote / np.maximum(total, 1e-300), 0, 1), self.prior)


def learn_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", folds: int = 3, held: int = 1, sample: int = SAMPLE) -> LatentVote:
    """Fit on at most ``sample`` labelled rows of each label (0 and 1), drawn by hash of the key, none from fold ``held``.

    Null keys and null labels are not learned from; a key with several labels counts with its
    smallest, a key with several texts with the smallest text.  Each sampled row's votes are scaled so
    that the sample stands for all labelled rows.
    """
    spark = docs.sparkSession
    df = np.zeros(TERMS + 1)
    seen = small_batches(docs).select(F.col(text).cast("string").alias("text")).mapInArrow(_frequencies, "term long, n long")
    for r in seen.groupBy("term").agg(F.sum("n").alias("n")).collect():  # one row per hashed term
        df[r["term"]] = r["n"]
    idf = np.log1p(df[TERMS] / np.maximum(1, df[:TERMS])).astype(np.float32)

    known = labels.select(F.col(key).cast("string").alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label in (0, 1)")
    known = known.where(hashed_remainder(F.col("key"), folds) != held).groupBy("key").agg(F.min("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = hash_sample(known, "label", ["key"], sample).select("key", "label")  # at most 2 * sample rows
    texts = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), "key")
    texts = texts.groupBy("key", "label").agg(F.min("text").alias("text")).select("label", "text")
    rows = texts.mapInArrow(_sparse, "label int, terms array<long>, counts array<long>").collect()
    rows.sort(key=lambda r: (r["label"], r["terms"], r["counts"]))

    counts = np.zeros((len(rows), TERMS), np.int64)
    for i, r in enumerate(rows):
        counts[i, r["terms"]] = r["counts"]
    y = np.array([r["label"] for r in rows], np.float64)
    prior = sizes.get(1, 0) / max(1, sum(sizes.values())) if sizes else 0.5
    weights = np.array([sizes[int(v)] / max(1, (y == v).sum()) for v in y])
    model = LatentVote(idf, np.eye(TERMS, RANK, dtype=np.float32), np.zeros((0, RANK), np.float32), y, weights, prior)
    if len(rows):
        x = unit_parts(np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf)
        model.axes = _latent_axes(x, min(RANK, *x.shape)).astype(np.float32)
        model.vectors = model.project(counts).astype(np.float32)
    return model


def _latent_axes(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    q = np.linalg.qr(x.T @ np.random.default_rng(3).normal(size=(len(x), min(2 * rank, len(x)))))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return q @ v.T[:, :rank]


def with_score(docs: DataFrame, model: LatentVote, name: str, text: str = "text", least: float | None = None) -> DataFrame:
    """``docs`` with the column ``name`` (0 to 1); with ``least``, only rows that reach it."""
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            buf, off, _ = utf8(batch.column(place))
            out = np.zeros(batch.num_rows)
            for lo, hi in chunks(off):
                for a in range(lo, hi, STEP):
                    b = min(hi, a + STEP)
                    out[a:b] = model.scores(term_counts(buf[off[a] : off[b]], off[a : b + 1] - off[a]))
            done = pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name])
            yield done if least is None else done.filter(pa.array(out >= least))

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return small_batches(docs).mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``, from the text alone.

    Null and empty texts, and others without terms, get the share of label 1 among the labels
    learned (0.5 without any).  Repeated rows score alike; an empty table gives no rows.
    """
    model = learn_quality(docs, labels, key=key, text=text, folds=folds, held=held)
    src = docs.select(F.col(key).alias("doc_id"), (hashed_remainder(F.col(key), folds) == held).alias("held_out"), F.col(text).cast("string").alias("text"))
    out = with_score(src, model, "score", "text")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, known: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more under a model of ``known`` and ``labels``, with the columns of ``docs``."""
    name = free_name(docs, "__score")
    return with_score(docs, learn_quality(known, labels, key=key, text=text), name, text, 0.5).drop(name)
