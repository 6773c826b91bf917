"""Language of a text from a small convolutional network over its bytes, trained and applied in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.arrowtext import chunks, utf8
from proofmill.llm.common import hash_sample, small_batches

WINDOW, WIDTHS, FILTERS, DIM = 192, (2, 3, 4), 16, 8
#: At most this many labelled rows of each language are learned from, three windows of each.
SAMPLE = 300


def hashed_remainder(key, by: int) -> F.Column:
    """crc32 of the key as text, modulo ``by``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by


class ByteNetwork:
    """Byte embedding, filters of several widths, ReLU, maximum over positions, softmax."""

    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"emb": rng.normal(0, 0.3, (256, DIM))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes))
        self.p["bias"] = np.zeros(classes)

    def _forward(self, x: np.ndarray):
        p, pooled, places = self.p, [], []
        e = p["emb"][x]
        for w in WIDTHS:
            patches = np.concatenate([e[:, i : x.shape[1] - w + 1 + i] for i in range(w)], 2)
            z = patches @ p[f"w{w}"] + p[f"b{w}"]
            at = z.argmax(1)
            places.append(at)
            pooled.append(np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0], 0))
        h = np.concatenate(pooled, 1)
        logits = h @ p["out"] + p["bias"]
        logits -= logits.max(1, keepdims=True)
        q = np.exp(logits)
        return e, places, h, q / q.sum(1, keepdims=True)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        p, n = self.p, len(x)
        e, places, h, q = self._forward(x)
        d = q.copy()
        d[np.arange(n), y] -= 1
        d /= n
        g = {"out": h.T @ d, "bias": d.sum(0), "emb": np.zeros_like(p["emb"])}
        dh = (d @ p["out"].T) * (h > 0)
        for k, (w, at) in enumerate(zip(WIDTHS, places)):
            part = dh[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"b{w}"] = part.sum(0)
            spots = at[:, :, None] + np.arange(w)  # rows, filters, offsets
            rows = np.arange(n)[:, None, None]
            patch = e[rows, spots].reshape(n, FILTERS, w * DIM)
            g[f"w{w}"] = np.einsum("nf,nfk->kf", part, patch)
            back = (part[:, :, None] * p[f"w{w}"].T).reshape(n, FILTERS, w, DIM)
            np.add.at(g["emb"], x[rows, spots], back)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                t += 1
                for k, g in self._gradients(x[rows], y[rows]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def tables(self) -> dict[str, np.ndarray]:
        """What inference needs: each filter's sum over a byte pair, so a position costs one or two look-ups."""
        one = lambda w, i: self.p["emb"] @ self.p[f"w{w}"][i * DIM : (i + 1) * DIM]
        pair = lambda w, i: (one(w, i)[:, None] + one(w, i + 1)[None]).reshape(65536, FILTERS).astype(np.float32)
        out = {"2a": pair(2, 0), "3a": pair(3, 0), "3b": one(3, 2).astype(np.float32), "4a": pair(4, 0), "4b": pair(4, 2)}
        return out | {k: self.p[k].astype(np.float32) for k in ("b2", "b3", "b4", "out", "bias")}


def log_probabilities(x: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Per window the log probability of each class."""
    out = []
    for i in range(0, len(x), 128):
        b = x[i : i + 128].astype(np.int64)
        pair = b[:, :-1] * 256 + b[:, 1:]
        h = [
            t["2a"][pair].max(1) + t["b2"],
            (t["3a"][pair[:, :-1]] + t["3b"][b[:, 2:]]).max(1) + t["b3"],
            (t["4a"][pair[:, :-2]] + t["4b"][pair[:, 2:]]).max(1) + t["b4"],
        ]
        z = np.maximum(np.concatenate(h, 1), 0) @ t["out"] + t["bias"]
        z -= z.max(1, keepdims=True)
        out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
    return np.concatenate(out) if out else np.zeros((0, len(t["bias"])), np.float32)


def windows(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts cut into windows of WINDOW bytes, the last padded by zeros: (windows, row, bytes in the window)."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][row] + nth * WINDOW
    fill = np.minimum(WINDOW, offsets[1:][row] - start)
    at = start[:, None] + np.arange(WINDOW)
    x = buf[np.minimum(at, max(0, len(buf) - 1))] if len(buf) else np.zeros((0, WINDOW), np.uint8)
    x[np.arange(WINDOW) >= fill[:, None]] = 0
    return x, row, fill


def learn_languages(docs: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text", folds: int = 5, sample: int = SAMPLE) -> tuple[list[str], dict | None]:
    """Labels in order and the tables of a network trained on at most ``sample`` rows of each label.

    Rows whose hashed key falls in fold 0 are never learned from, nor rows without label or letter.
    The sample is drawn by hash of the key; three windows of each text reach the driver.
    """
    body = F.col(text).cast("string")
    fit = docs.where(F.col(label).isNotNull() & (hashed_remainder(F.col(key), folds) != 0) & body.rlike(r"\p{L}"))
    n = F.length(body)
    cut = [F.substring(body, 1, WINDOW), F.substr(body, F.greatest(F.lit(1), (n / 2).cast("int")), F.lit(WINDOW)), F.substr(body, F.greatest(F.lit(1), n - WINDOW), F.lit(WINDOW))]
    fit = fit.select(F.col(label).cast("string").alias("label"), F.col(key).alias("key"), n.alias("size"), F.array(*cut).alias("cuts"))
    drawn = hash_sample(fit, "label", ["key", "size"], sample)
    rows = sorted(drawn.select("label", F.xxhash64("key").alias("h"), "cuts").collect())
    names = sorted({r["label"] for r in rows})
    if not names:
        return [], None
    x, y = [], []
    for r in rows:
        for c in r["cuts"]:
            raw = c.encode()[:WINDOW]
            x.append(np.frombuffer(raw.ljust(WINDOW, b"\0"), np.uint8))
            y.append(names.index(r["label"]))
    return names, ByteNetwork(len(names)).fit(np.array(x), np.array(y)).tables()


def _predict(names: list[str], tables: dict):
    def run(batches):
        labels = np.array(names, object)
        for batch in batches:
            buf, off, _ = utf8(batch.column(2))
            for lo, hi in chunks(off):
                x, row, fill = windows(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                logs = log_probabilities(x, tables) * fill[:, None]
                total = np.stack([np.bincount(row, logs[:, j], hi - lo) for j in range(len(names))], 1)
                total /= np.maximum(1, np.diff(off[lo : hi + 1]))[:, None]
                q = np.exp(total - total.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(labels[q.argmax(1)], pa.string()), pa.array(q.max(1))], ["doc_id", "held_out", "lang", "p"])

    return run


def predict_languages(docs: DataFrame, learned, key: str = "doc_id", text: str = "text", folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per row of ``docs``, from the text alone.

    Whole texts are cut into windows of fixed length; the mean of the windows' log probabilities,
    weighted by their bytes, gives the label and its probability.  A null text, one without a letter,
    and every text where nothing could be learned give ``und`` and score 0.  Repeated rows are
    predicted alike; other columns are not read.
    """
    names, tables = learned
    body = F.col(text).cast("string")
    kind = docs.schema[key].dataType.simpleString()
    src = small_batches(docs).select(F.col(key).alias("doc_id"), (hashed_remainder(F.col(key), folds) == 0).alias("held_out"), body.alias("text"), F.coalesce(body.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    none = src.where("not lettered" if names else "true").select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if not names:
        return none
    found = src.where("lettered").select("doc_id", "held_out", "text").mapInArrow(_predict(names, tables), f"doc_id {kind}, held_out boolean, lang string, p double")
    return found.select("doc_id", "held_out", F.col("lang").alias("lang_pred"), F.least(F.col("p"), F.lit(1.0)).alias("score")).unionByName(none)
