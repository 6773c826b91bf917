"""Byte-level BPE by dynamic programming over byte prefixes.

For every prefix of a piece there is exactly one token that can come last in the prefix's encoding:
the one that forms a stable pair with the last token of what is left of it.  Storing that token for
each prefix makes the encoding of any prefix a walk backwards, lets bytes be appended without redoing
anything, and lets an edit be followed only until the stored tokens agree with the old ones again.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.arrowtext import chunks, utf8
from proofmill.llm.common import small_batches

NONE = 1 << 62
CACHE, LONG = 400_000, 64
PIECES = 200_000


class Vocabulary:
    """Ranks of byte strings with the merge tree of each, built from the ranks alone."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.backward: dict = {}  # byte -> {byte before it -> ...}; a token that starts here is under None
        for b, rank in ranks.items():
            node = self.backward
            for byte in reversed(b):
                node = node.setdefault(byte, {})
            node[None] = rank
        self._spines: dict[tuple[int, bool], tuple[int, ...]] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._stable: dict[int, bool] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge completes ``token``; None for a single byte."""
        if token not in self._halves:
            parts = [bytes([b]) for b in self.bytes[token]]
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], NONE))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def spine(self, token: int, right: bool) -> tuple[int, ...]:
        """The token, its outer half, that one's outer half ... down to the outermost byte."""
        if (token, right) not in self._spines:
            out = [token]
            while (pair := self.halves(out[-1])) is not None:
                out.append(pair[right])
            self._spines[token, right] = tuple(out)
        return self._spines[token, right]

    def stable(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b in rank order never joins across the border.

        Both sides are replayed from their outer bytes in rank order; a join across the border wins
        against a later merge of the left side and against an equal or later one of the right side.
        """
        known = self._stable.get(a << 32 | b)
        if known is None:
            x, y = self.spine(a, True), self.spine(b, False)
            i, j, known = len(x) - 1, len(y) - 1, True
            while True:
                across = self.ranks.get(self.bytes[x[i]] + self.bytes[y[j]], NONE)
                left, right = (x[i - 1] if i else NONE), (y[j - 1] if j else NONE)
                if across < left and across <= right and across < NONE:
                    known = False
                    break
                if not i and not j:
                    break
                if left <= right:
                    i -= 1
                else:
                    j -= 1
            if len(self._stable) > 2 * CACHE:
                self._stable.clear()
            self._stable[a << 32 | b] = known
        return known


def extend(vocabulary: Vocabulary, data: bytes, last: list[int], first: int, end: int) -> None:
    """Add the last tokens of the prefixes of ``first`` to ``end`` bytes to those of all shorter ones.

    Tokens that end at a prefix are found by walking its bytes backwards; the longest that forms a
    stable pair with the last token of the rest is the only valid one.
    """
    tree, stable, known = vocabulary.backward, vocabulary.stable, vocabulary._stable.get
    for at in range(first, end + 1):
        node, i, found = tree, at, []
        while i:
            node = node.get(data[i - 1])
            if node is None:
                break
            i -= 1
            if None in node:
                found.append((i, node[None]))
        for start, token in reversed(found):
            if not start:
                break
            before = last[start]
            ok = known(before << 32 | token)
            if ok is None:
                ok = stable(before, token)
            if ok:
                break
        last.append(token)


def walk(vocabulary: Vocabulary, last: list[int], end: int) -> list[int]:
    """The tokens of the first ``end`` bytes, read from the last one backwards."""
    out = []
    while end:
        out.append(last[end])
        end -= len(vocabulary.bytes[out[-1]])
    return out[::-1]


class PrefixTable:
    """The last token of every prefix of one piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        """Only the new prefixes are looked at."""
        start = len(self.data)
        self.data += more
        extend(self.vocabulary, self.data, self.last, start + 1, len(self.data))
        return self

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start .. end-1; returns how many prefixes were looked at.

        After the edit, once as many stored tokens in a row as the longest token has bytes come out
        as before, all later ones are as before too.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        agree, done = 0, 0
        for at in range(start + 1, len(self.data) + 1):
            extend(self.vocabulary, self.data, self.last, at, at)
            token = self.last[at]
            done += 1
            before = at - shift
            agree = agree + 1 if before > end and old[before] == token else 0
            if agree >= self.vocabulary.longest:
                self.last += old[before + 1 :]
                break
        return done

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes."""
        return walk(self.vocabulary, self.last, len(self.data) if end is None else end)


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """A file with one base64 token and its rank on each line, read once per worker."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


class _Packed(dict):
    """Piece -> ids as little-endian 32-bit integers; emptied when full."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def _pack(self, last: list[int]) -> bytes:
        tokens = walk(self.vocabulary, last, len(last) - 1)
        return struct.pack(f"<{len(tokens)}I", *tokens)

    def __missing__(self, piece: str) -> bytes:
        data, last = piece.encode(), [-1]
        extend(self.vocabulary, data, last, 1, len(data))
        ids = self._pack(last)
        if len(data) <= LONG:
            self[piece] = ids
        return ids

    def learn(self, pieces: set[str]) -> None:
        """Encode the new pieces in sorted order: each starts from the prefix that it shares with the one before."""
        if len(self) + len(pieces) > CACHE:
            self.clear()
        last, before = [-1], b""
        for data, piece in sorted((p.encode(), p) for p in pieces.difference(self)):
            if len(data) > LONG:
                continue
            same = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                same += 1
            del last[same + 1 :]
            extend(self.vocabulary, data, last, same + 1, len(data))
            self[piece], before = self._pack(last), data


@lru_cache(maxsize=4)
def _packed(path: str) -> _Packed:
    return _Packed(load(path))


def _encode(path: str, pattern: str):
    def run(batches):
        cache, split = _packed(path), regex.compile(pattern)

        def long(text: str) -> bytes:
            pieces, parts = (m.group() for m in split.finditer(text)), []
            while block := list(islice(pieces, PIECES)):
                cache.learn(set(block))
                parts.append(b"".join(map(cache.__getitem__, block)))
            return b"".join(parts)

        def every(texts: list[str]) -> list[bytes]:
            if len(texts) == 1:
                return [long(texts[0])]
            pieces = [split.findall(t) for t in texts]
            cache.learn(set(chain.from_iterable(pieces)))
            return [b"".join(map(cache.__getitem__, p)) for p in pieces]

        for batch in batches:
            _, off, _ = utf8(batch.column(1))
            for lo, hi in chunks(off):
                out = every([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids packed as little-endian unsigned 32-bit integers, one row per row of ``docs``.

    Each match of ``pattern`` is encoded on its own by the ranks in the file at ``path``; there are no
    special tokens.  Null and empty texts give no ids.  Other columns are not read.
    """
    src = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(_encode(path, pattern), "doc_id long, n_tokens long, ids binary")


def _decode(path: str):
    def run(batches):
        table = load(path).bytes
        for batch in batches:
            buf, off, _ = utf8(batch.column("ids"))
            for lo, hi in chunks(off):
                out = [b"".join(map(table.__getitem__, np.frombuffer(buf[off[i] : off[i + 1]].tobytes(), "<u4").tolist())) for i in range(lo, hi)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    return run


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` with a column ``decoded``: the bytes of the packed ids; an unknown id is an error."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(_decode(path), f"{kinds}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): encoded, then decoded from the ids."""
    out = decode(encode(docs, path, pattern, key, text), path)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
