"""Toxic passages by maximum-scoring segments of token log-odds, with extreme-value statistics.

A token is a word or, for words that tell nothing themselves, one of their beginnings, the longest that is
known; so inflected forms count with their stem.  Tokens that stand out in labelled toxic texts get the
log-odds of the two classes under a Dirichlet prior, whose shape are the tokens' counts over all
documents.  In a text each word gains its token's log-odds and pays a small drift; the scan of Ruzzo and Tompa then finds all maximal segments in linear time.
For texts of N words the number of chance segments of score S is K N exp(-lambda S) (Karlin and Altschul), so
segments get expectations, the significant ones are summed up to a p-value of the text, and that
becomes the probability of the label by the Bayes factor of p-values.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill.llm.arrowtext import ALNUM, U64, chunks, shingle_hashes, utf8, word_hashes, word_spans
from proofmill.llm.bytecnn import hashed_remainder
from proofmill.llm.common import small_batches, stage

#: At most about this many labelled texts of each label are learned from.
SAMPLE = 8_000
#: Lengths in bytes of the beginnings that are tokens beside whole words.
STEMS = (8, 7, 6, 5, 4)
#: Tokens kept: at least so many toxic texts, a signed root of the likelihood ratio, and a number.
LEAST_TEXTS, LEAST_ROOT, TERMS = 3, 4.5, 1 << 15
#: Weight of the prior as a share of all learned counts; cost of a word; expectation up to which a segment is significant.
PRIOR, DRIFT, SIGNIFICANT = 0.02, 0.1, 0.1
WORDS = 1 << 20
EMPTY = np.zeros(0, np.int64)


def token_levels(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, n: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, hashes) of those among ``words`` as they are, or of the first ``n`` bytes of the longer ones."""
    if n is None:
        return words, word_hashes(buf, starts[words], ends[words], ALNUM[1])
    words = words[ends[words] - starts[words] > n]
    return words, word_hashes(buf, starts[words], starts[words] + n, ALNUM[1]) ^ U64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def known_tokens(model, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, token numbers) of the words with a known token, the most special one of each."""
    left, found = np.arange(len(starts)), []
    for n in (None, *STEMS):
        at, hashes = token_levels(buf, starts, ends, left, n)
        place, token = model.look_up(hashes)
        found.append((at[place], token))
        rest = np.ones(len(starts), bool)
        rest[at[place]] = False
        left = left[rest[left]]
    words, tokens = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(words)
    return words[order], tokens[order]


def maximal_segments(places: np.ndarray, gains: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first place, last place, score) of a row of words that each cost ``drift``, ``gains`` being added at ``places``."""
    found: list[list] = []  # first, last, total before, total after, nearest earlier segment with a smaller total before
    total, at = 0.0, -1
    for place, gain in zip(places.tolist(), gains.tolist()):
        total -= drift * (place - at - 1)
        at, before = place, total
        total += gain - drift
        if total <= before:
            continue
        new = [place, place, before, total, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


def sum_p_value(scores: list[float]) -> float:
    """P-value of the best sum of normalised scores, over all numbers of segments taken, largest first (Karlin and Altschul)."""
    best, total = 0.0, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        total += s
        if total <= 0:
            break
        tail = total - (r - 1) * log(total) + lgamma(r + 1) + lgamma(r) + r * log(2)  # halved for each further segment
        best = max(best, tail)
    return exp(-best)


def bayes_factor(p: float) -> float:
    """What a p-value says for the label against chance, averaged over all laws p ** (x - 1) * x with x from 0 to 1; at least 1."""
    p = max(p, 1e-300)
    return max(1.0, (1 - p + p * log(p)) / (p * log(p) ** 2)) if p < 0.5 else 1.0


@dataclass
class ToxicModel:
    """Sorted token hashes with their log-odds, parameters of the extreme-value law, share of label 1."""

    tokens: np.ndarray
    gains: np.ndarray
    rate: float = 1.0
    factor: float = 1.0
    prior: float = 0.5
    drift: float = DRIFT

    def __post_init__(self):
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.tokens >> U64(42)] = True

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among ``hashes``, token numbers) of the known tokens."""
        if not len(self.tokens):
            return EMPTY, EMPTY
        maybe = np.flatnonzero(self.bits[hashes >> U64(42)])
        at = np.minimum(np.searchsorted(self.tokens, hashes[maybe]), len(self.tokens) - 1)
        same = self.tokens[at] == hashes[maybe]
        return maybe[same], at[same]

    def hits(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, gains) of the words with a known token."""
        if not len(self.tokens):
            return EMPTY, np.zeros(0)
        words, tokens = [EMPTY], [EMPTY]
        for a in range(0, len(starts), WORDS):
            at, token = known_tokens(self, buf, starts[a : a + WORDS], ends[a : a + WORDS])
            words.append(at + a)
            tokens.append(token)
        return np.concatenate(words), self.gains[np.concatenate(tokens)]

    def passages(self, buf: np.ndarray, offsets: np.ndarray):
        """(words of the row, maximal segments as word numbers and score, byte spans of its words) for each row."""
        starts, ends, rows = word_spans(buf, offsets, ALNUM[0])
        words, gains = self.hits(buf, starts, ends)
        cut = np.searchsorted(words, rows)
        for i in range(len(offsets) - 1):
            a, b = cut[i], cut[i + 1]
            segments = maximal_segments(words[a:b] - rows[i], gains[a:b], self.drift) if b > a else []
            yield int(rows[i + 1] - rows[i]), segments, (starts[rows[i] : rows[i + 1]], ends[rows[i] : rows[i + 1]])

    def normalised(self, n: int, score: float) -> float:
        """Minus the logarithm of the expected number of chance segments that score as much in n words."""
        return self.rate * score - log(self.factor * max(1, n))

    def probability(self, n: int, segments) -> float:
        """Probability of label 1, from the p-value of the significant segments."""
        kept = [s for s in (self.normalised(n, score) for _, _, score in segments) if s >= -log(SIGNIFICANT)]
        return self.prior / (self.prior + (1 - self.prior) / bayes_factor(sum_p_value(kept) if kept else 1.0)) if self.prior > 0 else 0.0


def _least_shingle(batches):
    """(label, order, text, least): texts with their least hash of five words, which near copies share."""
    for batch in batches:
        buf, off, _ = utf8(batch.column(2))
        starts, ends, rows = word_spans(buf, off, ALNUM[0])
        words = word_hashes(buf, starts, ends, ALNUM[1])
        least = [int(h.min().view(np.int64)) if len(h) else 0 for h in (shingle_hashes(words[a:b], min(5, b - a)) if b > a else words[:0] for a, b in zip(rows, rows[1:]))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], [*batch.schema.names, "least"])


def _token_texts(batches):
    """(token, word, toxic texts, other texts): in how many texts of a chunk each word stands, for the word itself and each of its beginnings."""
    for batch in batches:
        label = batch.column(0).to_numpy()
        buf, off, _ = utf8(batch.column(1))
        for lo, hi in chunks(off):
            part = buf[off[lo] : off[hi]]
            starts, ends, rows = word_spans(part, off[lo : hi + 1] - off[lo], ALNUM[0])
            row = np.repeat(np.arange(hi - lo), np.diff(rows))
            h = word_hashes(part, starts, ends, ALNUM[1])
            order = np.lexsort((row, h))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
            order = order[new]  # one place for each word and text
            words, first, inverse = np.unique(h[order], return_index=True, return_inverse=True)
            y1 = np.bincount(inverse, label[lo:hi][row[order]], len(words)).astype(np.int64)
            y0 = np.bincount(inverse, minlength=len(words)) - y1
            by_place = np.argsort(order[first])
            place, words, y1, y0 = order[first][by_place], words[by_place], y1[by_place], y0[by_place]
            for n in (None, *STEMS):
                at, tokens = token_levels(part, starts[place], ends[place], np.arange(len(place)), n)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(words[at].view(np.int64)), pa.array(y1[at]), pa.array(y0[at])], ["token", "word", "y1", "y0"])


def _corpus_counts(model: ToxicModel):
    """(token number, occurrences) of the known tokens; number -1 counts all words."""

    def run(batches):
        total = np.zeros(len(model.tokens) + 1, np.int64)
        for batch in batches:
            buf, off, _ = utf8(batch.column(0))
            for lo, hi in chunks(off):
                part = buf[off[lo] : off[hi]]
                starts, ends, _ = word_spans(part, off[lo : hi + 1] - off[lo], ALNUM[0])
                total[-1] += len(starts)
                for a in range(0, len(starts), WORDS):
                    total[:-1] += np.bincount(known_tokens(model, part, starts[a : a + WORDS], ends[a : a + WORDS])[1], minlength=len(model.tokens))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == len(model.tokens), -1, at)), pa.array(total[at])], ["at", "n"])

    return run


def _chance(model: ToxicModel):
    """(words, scores of the maximal segments) of each text."""

    def run(batches):
        for batch in batches:
            buf, off, _ = utf8(batch.column(0))
            for lo, hi in chunks(off):
                got = [(n, [s for _, _, s in found]) for n, found, _ in model.passages(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.float64()))], ["n", "scores"])

    return run


def decay_rate(chances: np.ndarray, gains: np.ndarray, drift: float) -> float:
    """The positive lambda at which the mean of exp(lambda * score) of a word is 1; ``chances`` are those of the gains."""
    rest = max(0.0, 1.0 - float(chances.sum()))
    mean = lambda x: float((chances * np.exp(x * (gains - drift))).sum()) + rest * exp(-x * drift)
    low, high = 0.0, 1.0
    while mean(high) < 1 and high < 1e3:
        high *= 2
    for _ in range(80):
        x = (low + high) / 2
        low, high = (x, high) if mean(x) < 1 else (low, x)
    return high


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, folds: int, held: int, sample: int) -> tuple[DataFrame, dict]:
    """(label, text) of about ``sample`` labelled texts of each label, near copies once, and the number of labelled keys of each label.

    Keys are drawn where their hash is below the label's share, so no label is sorted in one place.  Of texts of
    one label with the same least hash of five words one stays.  Null keys and labels are left out, a key with
    several labels counts with its smallest.
    """
    known = labels.select(F.col(key).cast("string").alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label in (0, 1)")
    known = known.where(hashed_remainder(F.col("key"), folds) != held).groupBy("key").agg(F.min("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("label") == 1, sample / max(1, sizes.get(1, 0))).otherwise(sample / max(1, sizes.get(0, 0)))
    drawn = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share * (1 << 30))
    src = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), "key")
    src = small_batches(src).select("label", F.xxhash64("key", "text").alias("order"), "text").mapInArrow(_least_shingle, "label int, order long, text string, least long")
    one = src.groupBy("label", "least").agg(F.min(F.struct("order", "text")).alias("t"))
    return stage(one.select("label", F.coalesce("t.text", F.lit("")).alias("text"))), sizes


def learn_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", folds: int = 5, held: int = 0, sample: int = SAMPLE) -> ToxicModel:
    """Fit on labelled texts outside fold ``held``; the prior's counts cover all documents.

    At most TERMS tokens and their counts reach the driver.  Without labels of both kinds nothing is known and
    every text gets the share of label 1 (0.5 without any label).
    """
    texts, sizes = labelled_texts(docs, labels, label, key, text, folds, held, sample)
    none = ToxicModel(np.zeros(0, U64), np.zeros(0), prior=sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5)
    words = stage(texts.mapInArrow(_token_texts, "token long, word long, y1 long, y0 long").groupBy("token", "word").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")))
    n1, n0 = words.where("token = word").agg(F.sum("y1"), F.sum("y0")).first()  # (word, text) pairs of either label
    if not n1 or not n0:
        return none
    # a beginning counts without its most frequent word, which speaks for itself
    top = F.max(F.when(F.col("token") != F.col("word"), F.struct("y1", "y0", "word")))
    counts = words.groupBy("token").agg((F.sum("y1") - F.coalesce(top["y1"], F.lit(0))).alias("y1"), (F.sum("y0") - F.coalesce(top["y0"], F.lit(0))).alias("y0"))
    y1, y0 = F.col("y1"), F.col("y0")
    part = lambda y, n: F.when(y > 0, y * F.log(y * (n1 + n0) / ((y1 + y0) * n))).otherwise(0.0)
    root = F.sqrt(F.greatest(F.lit(0.0), 2 * (part(y1, n1) + part(y0, n0))))
    telling = counts.where((y1 >= LEAST_TEXTS) & (y1 * n0 > y0 * n1)).withColumn("root", root).where(F.col("root") >= LEAST_ROOT)
    rows = telling.orderBy(F.desc("root"), "token").limit(TERMS).collect()
    if not rows:
        return none
    tokens = np.array([r["token"] for r in rows], np.int64).view(U64)
    order = np.argsort(tokens)
    tokens = tokens[order]
    y1, y0 = (np.array([r[c] for r in rows], np.float64)[order] for c in ("y1", "y0"))
    bare = ToxicModel(tokens, np.ones(len(tokens)))
    seen = np.zeros(len(tokens) + 1)
    everywhere = small_batches(docs).select(F.col(text).cast("string").alias("text")).mapInArrow(_corpus_counts(bare), "at long, n long")
    for r in everywhere.groupBy("at").agg(F.sum("n").alias("n")).collect():  # one row a token
        seen[r["at"]] = r["n"]
    weight = PRIOR * (n1 + n0)
    alpha = weight * np.maximum(seen[:-1], 1) / max(1, seen[-1])
    odds = lambda y, n: np.log((y + alpha) / (n + weight - y - alpha))
    gains = odds(y1, n1) - odds(y0, n0)
    keep = gains > DRIFT
    model = ToxicModel(tokens[keep], gains[keep], prior=none.prior)
    if not keep.any():
        return none
    chances = ((y0 + alpha) / (n0 + weight))[keep]
    model.rate = decay_rate(chances, model.gains, model.drift)
    # chance segments of the other label's texts: the factor is the least that their numbers never exceed
    found = texts.where("label = 0").select("text").mapInArrow(_chance(model), "n long, scores array<double>")
    words = found.agg(F.sum("n")).first()[0] or 0
    each = found.select(F.explode("scores").alias("s")).groupBy(F.floor(F.col("s") * 4).alias("q")).agg(F.count(F.lit(1)).alias("n"))
    above, most = 0, 0.5 * exp(model.rate * float(model.gains.min() - model.drift))
    for r in sorted(each.collect(), key=lambda r: -r["q"]):  # a row for each quarter of a unit of score
        above += r["n"]
        most = max(most, above * exp(model.rate * r["q"] / 4))
    model.factor = most / max(1, words)
    return model


def toxicity_scores(docs: DataFrame, model: ToxicModel, key: str = "doc_id", text: str = "text", folds: int = 5, held: int = 0) -> DataFrame:
    """(key, held_out, score, predicted): one row per row of ``docs``, from the text alone.

    Whole texts are scanned.  A text without a known token, null and empty ones included, gets the share of label 1.
    Repeated rows score alike; null keys stay; an empty table gives no rows; other columns are not read.
    """
    src = small_batches(docs).select(F.col(key).alias("key"), (hashed_remainder(F.col(key), folds) == held).alias("held_out"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            buf, off, _ = utf8(batch.column(2))
            out = []
            for lo, hi in chunks(off):
                out += [model.probability(n, found) for n, found, _ in model.passages(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["key", "held_out", "score"])

    schema = T.StructType([*src.schema.fields[:2], T.StructField("score", T.DoubleType())])
    return src.mapInArrow(run, schema).select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxic_passages(docs: DataFrame, model: ToxicModel, key: str = "doc_id", text: str = "text", expected: float = SIGNIFICANT) -> DataFrame:
    """(key, first_word, last_word, score, expectation, passage): every segment that chance makes at most ``expected`` times in its text.

    Words count from 0; the passage is the text from the first word's first byte to the last word's end.
    """
    src = small_batches(docs).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    names = ["key", "first_word", "last_word", "score", "expectation", "passage"]

    def run(batches):
        for batch in batches:
            buf, off, _ = utf8(batch.column(1))
            for lo, hi in chunks(off):
                part, rows = buf[off[lo] : off[hi]], []
                for i, (n, found, (starts, ends)) in enumerate(model.passages(part, off[lo : hi + 1] - off[lo])):
                    for a, b, score in found:
                        s = model.normalised(n, score)
                        if s >= -log(expected):
                            rows.append((i + lo, a, b, score, exp(-s), part[starts[a] : ends[b]].tobytes().decode(errors="replace")))
                if rows:
                    at, *rest = zip(*rows)
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(rest, kinds))], names)

    kinds = [T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.StringType()]
    schema = T.StructType([src.schema.fields[0], *(T.StructField(n, k) for n, k in zip(names[1:], kinds))])
    return src.mapInArrow(run, schema).withColumnRenamed("key", key)
