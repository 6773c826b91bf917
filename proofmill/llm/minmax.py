"""Near-duplicate groups by min-max hashing, every link confirmed on the full shingle sets.

One hash evaluation of a shingle under a permutation serves twice: the signature keeps the smallest
and the largest value, both of which two sets share with probability equal to their Jaccard
similarity.  Bands of ``rows`` values, half of them minima and half maxima, give candidate buckets; one
byte of each value is kept as a sketch that rules out unlike pairs before full sets are fetched.

Equal sets are one *class*.  In each bucket the most central member (the one that shares most
buckets) leads and is compared with the others; a group of near copies around one text costs one
comparison a member and leader.  What is left goes through an exact prefix join inside the groups of
one leader C: two linked sets A and B have |A ∩ B| >= t (|A| + |B|) / (1 + t)
and |A ∩ B ∩ C| <= min(|A ∩ C|, |B ∩ C|), so either they share a token outside C, or their sizes alone
leave the link open.  Both cases are joined by equality, so members that are alike but not linked
are not paired with each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.arrowtext import SPACED, U64, chunks, mix, shingle_hashes, utf8, word_hashes, word_spans
from proofmill.llm.common import bit_table, numbered, small_batches, stage, unpack_bits
from proofmill.operators.graph import connected_components

#: Chance with which a pair at the limit may be missed.
MISSED = 1e-4
BANDS, ROWS = 32, 5
#: The table that marks the texts whose sets are fetched again has 2**BITS bits; false marks only cost work.
BITS = 24


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the permutations, from a fixed counter."""
    base = mix(np.arange(1, 2 * count + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return (base[:count] | U64(1))[:, None], base[count:][:, None]


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each row; a row of fewer words is one shingle of all of them."""
    starts, ends, rows = word_spans(buf, offsets, SPACED[0])
    words = word_hashes(buf, starts, ends, SPACED[1])
    grams = shingle_hashes(words, k)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield shingle_hashes(words[a:b], b - a)
        else:
            yield words[:0]


def min_max_bands(found: np.ndarray, perms, bands: int, rows: int) -> tuple[np.ndarray, bytes]:
    """One 64-bit key per band and one byte per value; the first half of the bands uses minima, the second maxima."""
    low = np.full(len(perms[0]), ~U64(0), U64)
    high = np.zeros(len(perms[0]), U64)
    for i in range(0, len(found), 2048):
        h = found[i : i + 2048] * perms[0] + perms[1]
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    values = np.concatenate([low, high])
    sig = values.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=U64)
    for j in range(rows):
        key = mix(key ^ sig[:, j]) + U64(j)
    return key.view(np.int64), (mix(values) & U64(255)).astype(np.uint8).tobytes()


def _sketch(k: int, bands: int, rows: int):
    def run(batches):
        perms = _permutations(bands * rows // 2)
        none = np.zeros(0, np.int64)
        for batch in batches:
            buf, off, _ = utf8(batch.column(1))
            for lo, hi in chunks(off):
                n, digest, keys, bytes_ = [], [], [], []
                for s in shingle_sets(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k):
                    n.append(len(s))
                    digest.append(_digest(s) if len(s) else None)
                    key, sketch = min_max_bands(s, perms, bands, rows) if len(s) else (none, None)
                    keys.append(key)
                    bytes_.append(sketch)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))), pa.array(bytes_, pa.binary())],
                    ["doc_id", "n_shingles", "digest", "bands", "sketch"],
                )

    return run


def _digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _full_sets(k: int, bits: bytes, log2: int):
    """(doc_id, digest, items) of the rows whose hashed key is marked."""

    def run(batches):
        table = unpack_bits(bits)
        for batch in batches:
            marked = table[batch.column(2).to_numpy().view(U64) >> U64(64 - log2)]
            batch = batch.filter(pa.array(marked))
            buf, off, _ = utf8(batch.column(1))
            for lo, hi in chunks(off):
                sets = list(shingle_sets(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "digest", "items"])

    return run


def _alike(least: float):
    """Rows (a, b, sketch, sketch) whose share of equal bytes reaches ``least``."""

    def run(batches):
        for batch in batches:
            x, y = (utf8(batch.column(i))[0].reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.filter(pa.array((x == y).mean(1) >= least)).select([0, 1])

    return run


def _rows(batch, i: int) -> Iterator[np.ndarray]:
    buf, off, _ = utf8(batch.column(i))
    for a, b in zip(off[:-1], off[1:]):
        yield buf[a:b].view(U64)


def _shared(batches):
    """Rows (a, b, set, set) to (a, b, size, size, shared)."""
    for batch in batches:
        out = [np.zeros(batch.num_rows, np.int64) for _ in range(3)]
        for i, (p, q) in enumerate(zip(_rows(batch, 2), _rows(batch, 3))):
            both = np.concatenate([p, q])
            both.sort()
            out[0][i], out[1][i], out[2][i] = len(p), len(q), (both[1:] == both[:-1]).sum()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out)], ["a", "b", "na", "nb", "shared"])


#: Tokens are ordered by how often their hash value occurs in a table of this many cells, then by themselves.
CELLS = 1 << 18
GONE = ("gone0", "gone1", "gone2", "gone3")


def _cell_counts(batches):
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        total += np.bincount((utf8(batch.column(0))[0].view(U64) >> U64(46)).astype(np.int64), minlength=CELLS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["cell", "n"])


def _outside(counts: np.ndarray, percent: int):
    """Rows (kind, lead, cid, label, set of cid, set of lead) to the prefix of the tokens outside the leader, rarest first.

    ``gone`` marks, in 256 bits, the leader's tokens that the member lacks: a bit that only one of two
    members has stands for at least one token that the other does not lack.
    """

    def run(batches):
        for batch in batches:
            n, inside, needs, lost, prefix = [], [], [], [], []
            gone = np.zeros((batch.num_rows, 256), bool)
            for p, c in zip(_rows(batch, 4), _rows(batch, 5)):
                out = p[~np.isin(p, c, assume_unique=True)]
                shared = len(p) - len(out)
                need = max(1, -((100 * shared - percent * len(p)) // 100))  # at least t |A| - |A ∩ C| of them are shared
                out = out[np.lexsort((out, counts[(out >> U64(46)).astype(np.int64)]))]
                n.append(len(p))
                inside.append(shared)
                needs.append(need)
                lost.append(len(c) - shared)
                gone[len(n) - 1, c[~np.isin(c, p, assume_unique=True)] >> U64(56)] = True
                prefix.append(out[: max(0, len(out) - need + 1)].view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(x, pa.int64()) for x in (n, inside, needs, lost)), *map(pa.array, np.packbits(gone, 1).view(np.int64).T.copy()), tokens], ["kind", "lead", "cid", "label", "n", "inside", "need", "lost", *GONE, "tokens"])

    return run


def banding(percent: int, values: int = BANDS * ROWS, missed: float = 4e-6) -> tuple[int, int]:
    """(bands, rows): the longest bands of an even number of values that miss a pair at the limit with no more than ``missed``."""
    fit = [r for r in range(1, values // 2 + 1) if (1 - (percent / 100) ** r) ** (values // r // 2 * 2) <= missed]
    r = max(fit, default=1)
    return values // r // 2 * 2, r


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, bands: int | None = None, rows: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept): one row per row of ``docs``.

    Rows are linked when 100 * |A ∩ B| >= percent * |A ∪ B| for their sets of k-word shingles (64-bit
    hashes of lower-cased A-Z words; fewer words make one shingle).  ``class_id`` is the smallest key
    of the rows with an equal set, ``component_id`` the smallest key reachable over links, ``kept``
    says that the row carries that key.  Null and empty texts have an empty set and link with
    nothing.  Null keys never name a component; such a row is kept only where its component has no
    key at all.  Repeated rows are one class.  Other columns are not read.

    A pair at the limit misses all buckets with probability (1 - (percent / 100)^rows)^bands, about 3e-6 for 80 percent;
    bands and rows follow the percentage unless they are given, and values that miss more than MISSED are refused.
    """
    if bands is None and rows is None:
        bands, rows = banding(percent)
    bands, rows = bands or BANDS, rows or ROWS
    if (1 - (percent / 100) ** rows) ** bands > MISSED:
        raise ValueError(f"{bands} bands of {rows} miss too many pairs of {percent} percent")
    src = small_batches(docs).select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    sketches = stage(src.mapInArrow(_sketch(k, bands, rows), f"doc_id {kind}, n_shingles long, digest binary, bands array<long>, sketch binary"))
    full = sketches.where("n_shingles > 0").groupBy("digest")
    classes = full.agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()))

    # buckets with more than one class, and the sets of their classes from one text each
    spread = classes.select("cid", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    members = stage(spread.join(shared, "bucket"))
    wanted = classes.select("cid", "digest", "rep").join(members.select("cid").distinct(), "cid", "left_semi")
    bits = bit_table(wanted.select(F.xxhash64("rep").alias("h")), "h", BITS)
    sets = src.withColumn("h", F.xxhash64("doc_id")).mapInArrow(_full_sets(k, bits, BITS), f"doc_id {kind}, digest binary, items binary").alias("s")
    sets = sets.join(wanted.alias("w"), (F.col("s.digest") == F.col("w.digest")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    sets = stage(sets.groupBy("s.digest", "cid").agg(F.first("items").alias("items")).select("cid", "items"))

    labels = _components(members, classes.select("cid", "sketch"), sets, percent, bands * rows)
    named = classes.select("cid", "digest", "rep").join(labels, "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "comp").select("digest", F.col("rep").alias("class_id"), "component_id")
    out = sketches.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    own = F.col("digest").isNull()
    out = out.withColumn("component_id", F.when(own, F.col("doc_id")).otherwise(F.col("component_id")))
    out = out.withColumn("class_id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")))
    return out.select("doc_id", "n_shingles", "class_id", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component of :func:`near_duplicates` over its rows, with all columns.

    It is the row with the smallest key; rows without a key come last, and the row id decides between
    rows of one key.  Null and empty texts are components of one row, so all of them stay.
    """
    rows, row = numbered(docs)
    found = near_duplicates(rows, row, text, k, percent).select(F.col("doc_id").alias("row"), "component_id")
    named = rows.select(F.col(row).alias("row"), F.col(key).alias("key")).join(found, "row")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row"))
    stay = named.groupBy("component_id").agg(first.alias("m")).select(F.col("m.row").alias(row))
    return rows.join(stay, row, "left_semi").drop(row)


def _compared(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, values: int) -> DataFrame:
    """(a, b, na, nb, shared) of the pairs whose sketches do not rule a link out (six standard deviations)."""
    one = sketches.select(F.col("cid").alias("a"), F.col("sketch").alias("x"))
    two = sketches.select(F.col("cid").alias("b"), F.col("sketch").alias("y"))
    p = percent / 100
    least = p - 6 * (p * (1 - p) / values) ** 0.5
    close = pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(_alike(least), "a long, b long")
    close = stage(close)
    one = sets.select(F.col("cid").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("cid").alias("b"), F.col("items").alias("y"))
    got = close.join(two, "b").join(one, "a").select("a", "b", "x", "y")
    return stage(got.mapInArrow(_shared, "a long, b long, na long, nb long, shared long"))


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * percent).select("a", "b")


def _components(members: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, values: int) -> DataFrame:
    """(cid, component) of the classes that have a link; ``members`` has bucket, cid and the number of others in the bucket."""
    weight = stage(members.groupBy("cid").agg(F.sum("others").alias("weight")))
    lead = members.join(weight, "cid").groupBy("bucket").agg(F.max(F.struct("weight", "cid")).alias("m")).select("bucket", F.col("m.cid").alias("lead"))
    led = stage(members.select("bucket", "cid").join(lead, "bucket"))
    pairs = led.where("cid <> lead").select(F.col("lead").alias("a"), F.col("cid").alias("b")).distinct()
    met = _compared(pairs, sketches, sets, percent, values)
    star = _linked(met, percent)

    # each class: the most similar leader, and the weightiest leader that it is linked with
    likeness = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    homes = met.groupBy("b").agg(F.max(F.struct(likeness.alias("j"), F.col("a"))).alias("m")).select(F.col("b").alias("cid"), F.col("m.a").alias("home"))
    leaders = led.select(F.col("lead").alias("a"), F.col("lead").alias("b")).distinct()
    best = star.unionByName(leaders).join(weight.withColumnRenamed("cid", "a"), "a").groupBy("b").agg(F.max(F.struct("weight", "a")).alias("m"))
    best = stage(best.select(F.col("b").alias("cid"), F.col("m.a").alias("label")))
    jump = best.select(F.col("cid").alias("label"), F.col("label").alias("next"))
    best = best.join(jump, "label", "left").select("cid", F.coalesce("next", "label").alias("label"))
    named = stage(members.select("cid").distinct().join(best, "cid", "left").join(homes, "cid", "left").select("cid", F.coalesce("label", "cid").alias("label"), F.coalesce("home", "cid").alias("home")))

    live = led.join(named, "cid")
    mixed = live.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    live = stage(live.join(mixed, "bucket").select("lead", "cid", "label", "home").distinct())
    more = _linked(_compared(_open_pairs(live, named, sets, percent), sketches, sets, percent, values), percent)
    edges = star.unionByName(more)
    return connected_components(edges.select(F.col("a").alias("cid")).union(edges.select("b")), edges, "cid", "a", "b")


def _within():
    """Most that A ∩ B may hold inside the leader: what neither lacks."""
    alone = lambda x, y: sum(F.bit_count(F.col(f"{g}_{x}").bitwiseAND(F.bitwise_not(F.col(f"{g}_{y}")))) for g in GONE)
    both_lost = F.least(F.col("lost_a") - alone("a", "b"), F.col("lost_b") - alone("b", "a"))
    return F.col("inside_a") - F.col("lost_b") + both_lost


def _meetings(one: DataFrame, two: DataFrame, percent: int) -> DataFrame:
    """Rows of two members at a prefix token that both have, with ``open``: the tokens they must share outside the leader.

    The tokens outside are in one order for all, so a shared token's places bound what the pair can share outside: what stands
    before it and what follows.  Where that is less than ``open``, the pair is not made; a linked pair keeps all its shared tokens.
    """
    apart = F.when(F.col("at_home"), F.col("label_a") < F.col("label_b")).otherwise((F.col("label_a") != F.col("label_b")) & (F.col("home_a") != F.col("home_b")))
    sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    t = percent / 100
    open_ = (F.col("n_a") + F.col("n_b")) * (t / (1 + t)) - _within() - 1e-6
    rest = lambda s: F.col(f"n_{s}") - F.col(f"inside_{s}") - F.col(f"place_{s}")
    most = F.least("place_a", "place_b") + F.least(rest("a"), rest("b"))
    slim = lambda d, s: d.select("at_home", "lead", F.posexplode("tokens").alias(f"place_{s}", "token"), *(f"{c}_{s}" for c in ("cid", "label", "home", "n", "inside", "need", "lost", *GONE)))
    met = slim(one, "a").join(slim(two, "b"), ["at_home", "lead", "token"]).where(apart & sized & (most >= open_))
    return met.withColumn("open", open_)


def _open_pairs(live: DataFrame, named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of differently labelled members of one leader's buckets that may be linked.

    Two members with the same most similar leader ("home") are judged against that one; all others
    against the leader of the bucket, where members of its most frequent home are not joined with
    each other.  In both groups a pair shares a prefix token outside the leader, or the sizes are
    such that the parts inside the leader may suffice.
    """
    counts = np.zeros(CELLS, np.int64)
    for r in sets.select("items").mapInArrow(_cell_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most CELLS rows
        counts[r["cell"]] = r["n"]
    usual = live.groupBy("lead", "home").agg(F.count(F.lit(1)).alias("n")).groupBy("lead").agg(F.max(F.struct("n", "home")).alias("m"), F.count(F.lit(1)).alias("homes"))
    usual = usual.where("homes > 1").select("lead", F.col("m.home").alias("usual"))
    strangers = live.join(usual, "lead").select(F.lit(False).alias("at_home"), "lead", "cid", "label", "home", (F.col("home") != F.col("usual")).alias("odd"))
    family = live.where("home <> cid").select(F.lit(True).alias("at_home"), F.col("home").alias("lead"), "cid", "label", "home", F.lit(True).alias("odd")).distinct()
    rows = strangers.unionByName(family).where("cid <> lead")
    rows = rows.join(sets, "cid").join(sets.select(F.col("cid").alias("lead"), F.col("items").alias("of_lead")), "lead")
    rows = rows.select(F.struct("at_home", "odd", "home").alias("kind"), "lead", "cid", "label", "items", "of_lead")
    rows = rows.mapInArrow(_outside(counts, percent), "kind struct<at_home: boolean, odd: boolean, home: long>, lead long, cid long, label long, n long, inside long, need long, lost long, gone0 long, gone1 long, gone2 long, gone3 long, tokens array<long>")
    rows = stage(rows.select("kind.*", "lead", "cid", "label", "n", "inside", "need", "lost", *GONE, "tokens"))

    one = rows.where("odd").toDF(*(c if c in ("at_home", "lead", "tokens") else f"{c}_a" for c in rows.columns))
    two = rows.toDF(*(c if c in ("at_home", "lead", "tokens") else f"{c}_b" for c in rows.columns))
    t = percent / 100
    half = t / (1 + t)
    within = _within()
    met = _meetings(one, two, percent)
    # beyond the prefix that ends first lie at most need - 1 of its own tokens; with them a pair must reach what the parts inside the leader leave open
    met = met.groupBy("at_home", "lead", "cid_a", "cid_b").agg(F.count(F.lit(1)).alias("shared"), F.max(F.greatest("need_a", "need_b")).alias("rest"), F.max("open").alias("open"))
    token = met.where(F.col("shared") + F.col("rest") - 1 >= F.col("open")).select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"))

    low, high = F.ceil(F.col("n_a") * t), F.floor((F.col("inside_a") + 1) / half - F.col("n_a"))
    loose = one.drop("tokens").withColumn("low", low).withColumn("high", high).where("low <= high")
    linked = named.select(F.col("cid").alias("lead"), F.col("label").alias("led"))
    loose = loose.join(linked, "lead", "left").where("not at_home or label_a <> led").withColumn("n_b", F.explode(F.sequence("low", "high")))
    apart = (F.col("label_a") != F.col("label_b")) & (F.col("at_home") | (F.col("home_a") != F.col("home_b")))
    enough = within + 1 >= (F.col("n_a") + F.col("n_b")) * half
    size = loose.join(two.drop("tokens"), ["at_home", "lead", "n_b"]).where(apart & enough).select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"))
    return token.union(size).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
