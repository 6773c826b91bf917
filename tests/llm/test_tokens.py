import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from proofmill.llm import tokenfile
from proofmill.llm.bytebpe import PrefixTable, load, round_trip
from tests.llm.conftest import prose

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_prefix_tables_match_the_library(library):
    v, r = load(RANKS), random.Random(3)
    pool = ["the", " and", "ing", "aaaa", "    ", "é", "日本", "$$", "==", "1234", "\n", "token", "izer", "xq", "-", "A"]
    for _ in range(400):
        raw = "".join(r.choice(pool) for _ in range(r.randint(1, 12))).encode()
        if r.random() < 0.2:
            raw = bytes(r.randrange(256) for _ in range(r.randint(1, 30)))
        t = PrefixTable(v, raw)
        assert t.tokens() == library._core_bpe.encode_single_piece(raw)
        cut = r.randint(0, len(raw))
        assert PrefixTable(v, raw[:cut]).append(raw[cut:]).last == t.last
        assert t.tokens(cut) == PrefixTable(v, raw[:cut]).tokens()


def test_edit_stops_soon_and_equals_a_new_table():
    v = load(RANKS)
    raw = bytearray(prose(9, 800).encode())
    t = PrefixTable(v, bytes(raw))
    done = t.replace(100, 104, b"edited text")
    assert t.last == PrefixTable(v, bytes(raw[:100]) + b"edited text" + bytes(raw[104:])).last
    assert done < len(raw) / 2


def test_round_trip_matches_the_library(edge_docs, edge_rows, library, no_docs):
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(edge_docs, RANKS, P.PATTERN).collect()), key=str)
    want = []
    for k, t in edge_rows:
        ids = library.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert round_trip(no_docs, RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("n,lanes,steps", [(0, 8, 2), (1, 8, 2), (63, 8, 4), (5000, 16, 8), (100_000, 1024, 16)])
def test_blocks_round_trip(n, lanes, steps):
    r = np.random.default_rng(n)
    ids = np.minimum(r.geometric(0.01, n), 999)
    counts = np.bincount(ids, minlength=1000) + (np.arange(1000) == 5)
    freq = tokenfile.shared_frequencies(counts, 12)
    assert freq.sum() == 1 << 12 and ((freq > 0) == (counts > 0)).all()
    model = tokenfile.Model(freq, 12)
    blob = tokenfile.encode_block(ids, model, lanes, steps)
    assert (tokenfile.decode_block(blob, model) == ids).all()
    used = max(1, min(lanes, n // 64))
    parts = [tokenfile.decode_block(blob, model, s) for s in range(-(-n // (used * steps)))]
    assert n == 0 or (np.concatenate(parts) == ids).all()
    if n > 50:
        with pytest.raises(ValueError):
            tokenfile.decode_block(blob[:60] + bytes([blob[60] ^ 1]) + blob[61:], model)


def test_crc_of_two_parts():
    a, b = b"some bytes", bytes(1000)
    assert tokenfile.joined_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert tokenfile.joined_crc32(zlib.crc32(a), 0, 0) == zlib.crc32(a)


@pytest.mark.parametrize("block", [1 << 19, 1000])  # the second cuts the long text over many blocks
def test_files_match_the_library(spark, edge_docs, edge_rows, no_docs, tmp_path, block):
    path = P.path("word_bpe_49k.json")
    tokenfile.write_tokens(edge_docs, str(tmp_path / "t"), path, 49_408, 2, block=block)
    got = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.read_tokens(spark, str(tmp_path / "t"), 49_408).collect()}
    t, start, want = Tokenizer.from_file(path), 0, set()
    encoded = [(k, t.encode(x or "", add_special_tokens=False).ids + [2]) for k, x in edge_rows]
    for k, ids in sorted(encoded, key=lambda e: (e[0] is not None, e[0] or 0, len(e[1]))):
        want.add((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    tokenfile.write_tokens(no_docs, str(tmp_path / "e"), path, 49_408, 2)
    assert tokenfile.read_tokens(spark, str(tmp_path / "e"), 49_408).count() == 0
