import hashlib
import re
import zlib
from collections import Counter

import numpy as np

from proofmill.llm.exact import drop_exact_duplicates, exact_duplicates, misra_gries
from proofmill.llm.shards import byte_shards


def test_shards_are_contiguous_and_even(edge_docs, edge_rows):
    got = byte_shards(edge_docs, 4).collect()
    assert len(got) == len(edge_rows)
    size = lambda t: len((t or "").encode()) + 1
    want = Counter((k, size(t), zlib.crc32((t or "").encode())) for k, t in edge_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    order = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size))
    assert [r.shard for r in order] == sorted(r.shard for r in got)
    total, before = sum(r.size for r in got), 0
    for r in order:
        assert r.shard == min(3, (2 * before + r.size) * 4 // (2 * total))
        before += r.size
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_many_rows_near_equal_bytes(spark):
    docs = spark.range(4000).selectExpr("id % 3 as doc_id", "repeat('ab', cast(id % 50 as int)) as text")
    got = byte_shards(docs, 8).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * 101


def test_empty_tables(no_docs):
    assert byte_shards(no_docs).count() == 0
    assert exact_duplicates(no_docs).count() == 0
    assert drop_exact_duplicates(no_docs).count() == 0


def test_misra_gries_keeps_every_frequent_value():
    r = np.random.default_rng(1)
    values = np.concatenate([np.repeat(["a", "b"], [400, 300]), r.integers(0, 5000, 3000).astype(str)])
    r.shuffle(values)
    counters = {}
    for i in range(0, len(values), 100):
        v, c = np.unique(values[i : i + 100], return_counts=True)
        misra_gries(counters, v, c, 20)
    assert len(counters) <= 20
    for v, n in (("a", 400), ("b", 300)):
        assert n - len(values) / 21 <= counters[v] <= n


def _reference(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for k, t in rows:
        groups.setdefault(norm(t), []).append(k)
    out = []
    for k, t in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        out.append((k, keep, len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    return out, groups


def test_exact_duplicates(edge_docs, edge_rows):
    for counters in (1, 4, 1024):  # heavy and light paths
        got = exact_duplicates(edge_docs, counters=counters).collect()
        want, groups = _reference(edge_rows)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(want)
        assert sum(r.kept for r in got) == len(groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_drop_keeps_columns_and_one_of_repeated_rows(edge_docs, edge_rows):
    left = drop_exact_duplicates(edge_docs)
    assert left.columns == edge_docs.columns
    assert left.count() == len(_reference(edge_rows)[1])


def test_hot_group(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same   text', concat('text ', id % 1500)) as text")
    got = exact_duplicates(docs, counters=16)
    assert got.where("group_size = 2000 and keep_id = 0").count() == 2000
    assert got.where("kept").count() == got.select("text_sha256").distinct().count()


def test_text_keys_and_columns_with_names_of_ours(spark):
    from proofmill.llm.exact import drop_exact_duplicates, exact_duplicates
    from proofmill.llm.minmax import drop_near_duplicates

    rows = [("b", "one  text", 1, "x", 0.5), ("a", "one text", 2, "y", 0.5), (None, "one text", 3, "z", 0.5), ("c", "another", 4, None, 0.5), ("c", "another", 5, None, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, __row long, __digest string, __score double")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(docs).collect()}
    assert {("b", "a", 3, False), ("a", "a", 3, True), (None, "a", 3, False)} <= got
    for drop in (drop_exact_duplicates, drop_near_duplicates):
        left = drop(docs)
        assert left.columns == docs.columns
        kept = left.collect()
        assert {r.doc_id for r in kept} == {"a", "c"} and len(kept) == 2
        assert {r["__row"] for r in kept} <= {1, 2, 4, 5} and (2 in {r["__row"] for r in kept})
