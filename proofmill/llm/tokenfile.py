"""Token ids in entropy-coded block files: a static range asymmetric numeral system.

One frequency table, counted over all documents, is shared by every block.  A block holds the ids of
consecutive documents and is coded by ``lanes`` interleaved states (id i belongs to lane i mod lanes), so a
step handles all lanes at once.  Each block stands alone: its blob carries checkpoints (states and
stream position) from which any later section decodes without the ones before it, and checksums of
the ids and of the blob.  Blocks are rows of a Parquet folder, which gives them Spark's committer,
any file system and column pruning on the block directory.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill.llm.arrowtext import SPACED, U64, chunks, utf8, word_hashes, word_spans
from proofmill.llm.common import shuffle_tasks, small_batches, stage
from proofmill.session import stage_dir

BITS, LANES, STEPS, BLOCK = 20, 1024, 256, 1 << 19
LOW = 1 << 31
HEAD = struct.Struct("<4sIIIIIII")  # magic, ids, lanes, bits, steps between checkpoints, checkpoints, words, CRC-32 of the ids


def shared_frequencies(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Counts scaled to a sum of 2**bits; every id that occurs keeps at least 1."""
    total, whole = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.uint64)
    if int((counts > 0).sum()) > whole:
        raise ValueError("more distinct ids than slots")
    f = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * (whole / total)).astype(np.int64)), 0)
    order = np.argsort(-f, kind="stable")
    over = int(f.sum()) - whole
    if over <= 0:
        f[order[0]] -= over
    else:  # taken from the largest shares first
        room = np.maximum(f[order] - 1, 0)
        f[order] -= np.clip(over - (np.cumsum(room) - room), 0, room)
    return f.astype(np.uint64)


class Model:
    """Frequencies with their running sums and the id of each slot."""

    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.below = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.common = int(np.argmax(self.freq)) if len(freq) else 0
        self._slots = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, model: Model, lanes: int = LANES, steps: int = STEPS) -> bytes:
    lanes = max(1, min(lanes, len(ids) // 64))
    rows = -(-len(ids) // lanes)
    padded = np.full(rows * lanes, model.common, np.int64)
    padded[: len(ids)] = ids
    freq, below = model.freq[padded].reshape(rows, lanes), model.below[padded].reshape(rows, lanes)
    bits, top = np.uint64(model.bits), np.uint64(63 - model.bits)
    x = np.full(lanes, LOW, np.uint64)
    words, marks = [], {}
    for t in range(rows - 1, -1, -1):
        f = freq[t]
        full = x >= (f << top)
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << bits) + (x - q * f) + below[t]
        if t % steps == 0:
            marks[t] = x
    words.reverse()
    ends = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    body = b"".join(struct.pack("<I", int(ends[t])) + marks[t].astype("<u8").tobytes() for t in sorted(marks))
    stream = np.concatenate(words).astype("<u4").tobytes() if words else b""
    blob = HEAD.pack(b"RNS1", len(ids), lanes, model.bits, steps, len(marks), len(stream) // 4, zlib.crc32(ids.astype("<u4").tobytes())) + body + stream
    return blob + struct.pack("<I", zlib.crc32(blob))


def decode_block(blob: bytes, model: Model, section: int | None = None) -> np.ndarray:
    """All ids of a block, or those between one checkpoint and the next; a damaged blob is an error."""
    magic, n, lanes, bits, steps, marks, n_words, crc = HEAD.unpack_from(blob)
    if magic != b"RNS1" or zlib.crc32(blob[:-4]) != struct.unpack("<I", blob[-4:])[0]:
        raise ValueError("token block is damaged")
    size = 4 + 8 * lanes
    stream = np.frombuffer(blob, "<u4", n_words, HEAD.size + marks * size).astype(np.uint64)
    rows = -(-n // lanes)
    first, last = (0, rows) if section is None else (section * steps, min(rows, (section + 1) * steps))
    at = HEAD.size + (first // steps) * size
    out = np.empty((max(0, last - first), lanes), np.uint32)
    if rows:
        (pos,) = struct.unpack_from("<I", blob, at)
        x = np.frombuffer(blob, "<u8", lanes, at + 4).astype(np.uint64)
        shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
        for t in range(last - first):
            slot = x & mask
            s = model.slots[slot]
            out[t] = s
            x = model.freq[s] * (x >> shift) + slot - model.below[s]
            low = np.flatnonzero(x < np.uint64(LOW))
            x[low] = (x[low] << np.uint64(32)) | stream[pos : pos + len(low)]
            pos += len(low)
    ids = out.ravel()[: max(0, min(n - first * lanes, (last - first) * lanes))]
    if section is None and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("ids do not match their checksum")
    return ids


def joined_crc32(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings one after the other, from their own ones and the second's length."""

    def times(matrix, v):
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= matrix[i]
            v >>= 1
            i += 1
        return out

    step = [0xEDB88320, *(1 << i for i in range(31))]  # the effect of one zero bit
    for _ in range(3):
        step = [times(step, row) for row in step]
    while length:
        if length & 1:
            first = times(step, first)
        step = [times(step, row) for row in step]
        length >>= 1
    return first ^ second


#: Fixed values of the tokenizer files that are read here: how they normalise and split.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """(byte hashed as, byte is an ASCII mark)."""
    value = np.arange(1, 257, dtype=U64)
    value[65:91] = value[97:123]
    mark = np.zeros(256, bool)
    mark[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
    return value, mark


VALUE, IS_MARK = _classes()


class _Pieces:
    """Ids of the pieces of white-space separated words, as the library encodes them, found again by 64-bit hash.

    A word is cut before the ASCII marks at its end where an ASCII letter or digit or a Latin-1 letter
    stands before them: there a run of letters or a digit ends for this split pattern, and no character
    composes with an ASCII one after it.  A-Z are hashed as a-z, as the tokenizer lower-cases.  Pieces
    that could hold an added token, and long ones, are encoded as they are.  New pieces go to the
    library many at a time, with a lone control character between them; ids between two of those are one piece's.
    """

    BREAK, TOGETHER, LONG, BITS, KEPT = b"\x7f", 256, 64, 21, 1 << 23

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.library, self.kind = Tokenizer.from_file(path), np.dtype(kind)
        made = json.loads(self.library.to_str())
        normal = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
        splits = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
        first = splits[0] if splits else {}
        level = splits[1] if len(splits) == 2 else {}
        if normal != NORMALIZERS or first.get("pattern") != {"Regex": SPLIT} or not first.get("invert") or level.get("add_prefix_space") or level.get("use_regex"):
            raise ValueError("the tokenizer neither lower-cases nor splits as the cuts made here need it")
        added = [t["content"].encode() for t in made["added_tokens"]]
        self.first, self.last = np.zeros(256, bool), np.zeros(256, bool)
        self.first[[t[0] for t in added]] = True
        self.last[[t[-1] for t in added]] = True
        self.mark = self._ids(self.BREAK)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.BITS, U64)
        self.at = np.zeros(1 << self.BITS, np.int64)
        self.size = np.zeros(1 << self.BITS, np.int64)
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0

    def _ids(self, piece: bytes) -> list[int]:
        return self.library.encode(piece.decode(errors="replace"), add_special_tokens=False).ids

    def _store(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) of the ids of each piece, now in the store; short pieces without the break go to the library together."""
        at, size, done, parts, used = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), np.zeros(len(pieces), bool), [], self.used
        short = np.array([i for i, p in enumerate(pieces) if len(p) <= self.LONG and self.BREAK not in p] if len(self.mark) == 1 else [], np.int64)
        groups = [short[i : i + self.TOGETHER] for i in range(0, len(short), self.TOGETHER)]
        texts = [(b" " + self.BREAK + b" ").join([pieces[i] for i in g]).decode(errors="replace") for g in groups]
        for group, found in zip(groups, self.library.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, self.kind)
            inside = ids != self.mark[0]
            number = np.diff(np.concatenate([[-1], np.flatnonzero(~inside), [len(ids)]])) - 1
            if len(number) == len(group):
                at[group], size[group], done[group] = used + np.cumsum(number) - number, number, True
                parts.append(ids[inside])
                used += len(parts[-1])
        for i in np.flatnonzero(~done):
            parts.append(np.array(self._ids(pieces[i]), self.kind))
            at[i], size[i] = used, len(parts[-1])
            used += len(parts[-1])
        if used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(used, len(self.ids)), self.kind)])
        if parts:
            self.ids[self.used : used] = np.concatenate(parts)
        self.used = used
        return at, size

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        down = U64(64 - self.BITS)
        return h >> down, (h * U64(0x9E3779B97F4A7C15)) >> down

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets of the texts)."""
        if self.used > self.KEPT:
            self.clear()
        s, e, rows = word_spans(buf, offsets, SPACED[0])
        if not len(s):
            return np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
        marks = IS_MARK[buf]
        end = np.maximum.accumulate(np.where(marks, 0, np.arange(1, len(buf) + 1)))[e - 1]  # after the last byte that is no mark
        before, lead = buf[np.maximum(end - 1, 0)], buf[np.maximum(end - 2, 0)]
        letter = (before < 128) & ~IS_MARK[before] | (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        added = lambda which, a, b: (total := np.concatenate([[0], np.cumsum(which[buf])]))[b] > total[a]
        cut = (end > s) & (end < e) & letter & (before > 32) & (before != 127) & ~added(self.last, np.maximum(end, s), e)
        count = 1 + cut
        head = np.cumsum(count) - count
        starts, ends = np.repeat(s, count), np.repeat(e, count)
        ends[head[cut]] = end[cut]
        starts[head[cut] + 1] = end[cut]
        rows = np.concatenate([head, [len(starts)]])[rows]

        h = word_hashes(buf, starts, ends, VALUE)
        h[h == 0] = 1
        plain = (ends - starts <= self.LONG) & ~added(self.first, starts, ends)
        one, two = self._slots(h)
        slot = np.where(self.keys[one] == h, one, two)
        known = (self.keys[slot] == h) & plain
        at, size = self.at[slot], self.size[slot]
        fresh = np.flatnonzero(~known & plain)
        if len(fresh):
            keys, first, inverse = np.unique(h[fresh], return_index=True, return_inverse=True)
            place, number = self._store([buf[starts[i] : ends[i]].tobytes() for i in fresh[first]])
            at[fresh], size[fresh] = place[inverse], number[inverse]
            one, two = self._slots(keys)
            slot = np.where(self.keys[one] == 0, one, two)
            self.keys[slot], self.at[slot], self.size[slot] = keys, place, number
            # where two keys met in a slot, the one that stands there has its place
            _, lasts = np.unique(slot[::-1], return_index=True)
            last = len(slot) - 1 - lasts
            self.keys[slot[last]], self.at[slot[last]], self.size[slot[last]] = keys[last], place[last], number[last]
        odd = np.flatnonzero(~plain)
        if len(odd):
            texts: dict[bytes, int] = {}
            which = np.array([texts.setdefault(buf[starts[i] : ends[i]].tobytes(), len(texts)) for i in odd])
            place, number = self._store(list(texts))
            at[odd], size[odd] = place[which], number[which]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(at - upto[:-1], size) + np.arange(upto[-1])], upto[rows]


@lru_cache(maxsize=2)
def _pieces(path: str, kind: str) -> _Pieces:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return _Pieces(path, kind)


def _tokenize(path: str, end_id: int, kind: str):
    def run(batches):
        cache, width = _pieces(path, kind), np.dtype(kind).itemsize
        for batch in batches:
            buf, off, _ = utf8(batch.column(1))
            for lo, hi in chunks(off):
                ids, rows = cache.encode(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                n = hi - lo
                sizes = np.diff(rows) + 1
                out = np.full(len(ids) + n, end_id, kind)
                out[np.arange(len(ids)) + np.repeat(np.arange(n), sizes - 1)] = ids  # an end id after each row
                bounds = pa.py_buffer((np.concatenate([[0], np.cumsum(sizes)]) * width).astype(np.int32).tobytes())
                packed = pa.Array.from_buffers(pa.binary(), n, [None, bounds, pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(sizes, pa.int64()), packed], ["doc_id", "n_tokens", "ids"])

    return run


def _count(kind: str, size: int):
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(utf8(batch.column(0))[0].view(kind), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["id", "n"])

    return run


BLOCK_ROW = "part int, block long, first long, n_ids long, first_doc long, doc_ids array<long>, lengths array<long>, continues boolean, open boolean, blob binary"


def _blocks(kind: str, freq: np.ndarray, bits: int, most: int):
    """Sorted rows of one partition to blocks; only a document longer than a block is cut."""

    def run(batches):
        model, part = Model(freq, bits), TaskContext.get().partitionId()
        docs, lengths, parts, held, block, first, doc, continues = [], [], [], 0, 0, 0, 0, False

        def flush(is_open: bool):
            nonlocal held, block, first, continues
            row = [part, block, first, held, doc - len(docs) + is_open, list(docs), list(lengths), continues, is_open, encode_block(np.concatenate(parts), model)]
            kinds = [pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.binary()]
            docs.clear(), lengths.clear(), parts.clear()
            first, held, block, continues = first + held, 0, block + 1, is_open
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], [c.split()[0] for c in BLOCK_ROW.split(", ")])

        for batch in batches:
            buf, off, _ = utf8(batch.column(1))
            for i, key in enumerate(batch.column(0).to_pylist()):
                ids = buf[off[i] : off[i + 1]].view(kind).astype(np.int64)
                if held and held + len(ids) > most:
                    yield flush(False)
                while len(ids) > most:
                    docs.append(key), lengths.append(most), parts.append(ids[:most])
                    held, ids = most, ids[most:]
                    yield flush(True)
                docs.append(key), lengths.append(len(ids)), parts.append(ids)
                held += len(ids)
                doc += 1
        if held:
            yield flush(False)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> None:
    """Encode every text, append ``end_id``, and write block rows in ascending key order under ``path``.

    ``tokenizer`` is a tokenizers file of the kind that ``_Pieces`` states (else an error), so each distinct piece
    of a word is encoded by the library once in a task.  Null texts count as empty and hold only the end
    id; rows without a key come first; repeated keys follow each other.  Ids are shuffled, not texts.
    """
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    src = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tokens = stage(src.mapInArrow(_tokenize(tokenizer, end_id, kind), "doc_id long, n_tokens long, ids binary"))
    counted = tokens.select("ids").mapInArrow(_count(kind, vocabulary), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for r in counted.collect():  # at most one row per vocabulary entry
        counts[r["id"]] = r["n"]
    freq = shared_frequencies(counts)
    spark = docs.sparkSession
    at = np.flatnonzero(freq)
    spark.createDataFrame([(int(i), int(freq[i])) for i in at], "id int, freq long").coalesce(1).write.parquet(f"{path}/model")
    order = ["doc_id", "n_tokens", F.xxhash64("ids")]  # a hash, as the range sampler brings whole sort keys to the driver
    ranged = tokens.repartitionByRange(shuffle_tasks(docs), *order).sortWithinPartitions(*order)
    ranged.select("doc_id", "ids").mapInArrow(_blocks(kind, freq, BITS, block), BLOCK_ROW).write.option("compression", "none").parquet(f"{path}/blocks")


def _read(freq: np.ndarray, bits: int):
    """Decode blocks to one row per document segment."""

    def run(batches):
        model = Model(freq, bits)
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode_block(r["blob"], model)
                raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                rows = [[], [], [], [], [], [], []]
                last = len(r["lengths"]) - 1
                for j, (doc, n) in enumerate(zip(r["doc_ids"], r["lengths"])):
                    whole = not (j == 0 and r["continues"]) and not (j == last and r["open"])
                    for column, v in zip(rows, (r["part"], r["first_doc"] + j, doc, r["first"] + at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), whole)):
                        column.append(v)
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, [pa.int32(), *[pa.int64()] * 5, pa.bool_()])], ["part", "doc", "doc_id", "at", "n", "crc", "whole"])

    return run


@F.udf(T.LongType())
def _joined(segments):
    out = None
    for s in sorted(segments, key=lambda s: s["at"]):
        out = s["crc"] if out is None else joined_crc32(out, s["crc"], 4 * s["n"])
    return out


def read_tokens(spark, path: str, vocabulary: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files at ``path``.

    Blocks decode in any task; totals per written partition give the running start.  Segments of a
    document that fills several blocks are put together by their checksums.
    """
    freq = np.zeros(vocabulary, np.uint64)
    for r in spark.read.parquet(f"{path}/model").collect():
        freq[r["id"]] = r["freq"]
    blocks = spark.read.parquet(f"{path}/blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per written partition
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    found = blocks.mapInArrow(_read(freq, BITS), "part int, doc long, doc_id long, at long, n long, crc long, whole boolean")
    found = stage(found)
    cut = found.where("not whole").groupBy("part", "doc").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n"), F.collect_list(F.struct("at", "n", "crc")).alias("s"))
    rows = found.where("whole").select("part", "doc_id", "at", "n", "crc").unionByName(cut.select("part", "doc_id", "at", "n", _joined("s").alias("crc")))
    return rows.join(parts, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def token_files(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int) -> DataFrame:
    """Write the files in a new folder beside the stages and read them back."""
    path = f"{stage_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, vocabulary, end_id)
    return read_tokens(docs.sparkSession, path, vocabulary)
