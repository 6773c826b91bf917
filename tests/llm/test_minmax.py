from collections import Counter

import numpy as np
import pytest

from proofmill.llm.arrowtext import SPACED, U64, shingle_hashes, word_hashes, word_spans
from proofmill.llm.minmax import GONE, _meetings, _permutations, drop_near_duplicates, min_max_bands, near_duplicates
from tests.llm.conftest import edited, prose


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = low(text).encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((key, len(sets[i]), c, key == c))
    return Counter(out)


def as_counter(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_edges_match_brute_force(edge_docs, edge_rows):
    for k in (4, 5):
        assert as_counter(near_duplicates(edge_docs, k=k)) == components(edge_rows, k)


def test_empty_table(no_docs):
    assert near_duplicates(no_docs).count() == 0
    assert drop_near_duplicates(no_docs).columns == no_docs.columns


def test_large_group_of_near_copies_and_chains(spark):
    base = prose(5, 150)
    rows = [(i, edited(edited(base, (7 * i) % 150), (11 * i + 3) % 150)) for i in range(150)]
    rows += [(1000 + i, base) for i in range(150)]  # copies
    chain = prose(6, 160)
    for i in range(12):  # each is like the one before, the ends are not alike
        chain = edited(edited(chain, 12 * i), 12 * i + 6)
        rows.append((2000 + i, chain))
    rows += [(3000 + i, prose(50 + i, 60) + " " + prose(7, 90)) for i in range(60)]  # share a passage
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert as_counter(near_duplicates(docs, k=4)) == components(rows, 4)
    left = drop_near_duplicates(docs, k=4)
    assert left.count() == len({c for _, _, c, _ in components(rows, 4)})


def test_group_without_any_key(spark):
    docs = spark.createDataFrame([(None, prose(1, 80)), (None, edited(prose(1, 80), 40)), (1, prose(2, 80))], "doc_id long, text string")
    assert as_counter(near_duplicates(docs)) == Counter({(None, 76, None, True): 2, (1, 76, 1, True): 1})


def test_one_row_of_each_group_stays_whatever_the_keys(spark):
    a, b, c, d = (prose(i, 80) for i in range(20, 24))
    rows = [(3, a), (None, edited(a, 40)), (None, edited(a, 60)), (2, edited(a, 20)), (None, b), (None, edited(b, 40)), (None, b), (5, c), (5, c), (5, d), (None, None), (None, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [tuple(r) for r in drop_near_duplicates(docs).collect()]
    assert len(left) == 7
    assert (2, edited(a, 20)) in left and (5, c) in left and (5, d) in left
    assert sum(k is None and x in (b, edited(b, 40)) for k, x in left) == 1
    assert Counter(x for x in left if not x[1]) == Counter([(None, None), (None, ""), (9, "")])


def test_minimum_and_maximum_estimate_similarity():
    r = np.random.default_rng(2)
    items = r.integers(0, 2**63, 1500, dtype=np.int64).astype(U64)
    a, b = np.unique(items[:1200]), np.unique(items[300:])
    perms = _permutations(2000)
    low_high = lambda s: (s * perms[0] + perms[1]).min(1), lambda s: (s * perms[0] + perms[1]).max(1)
    truth = 900 / 1500
    for side in low_high:
        assert abs((side(a) == side(b)).mean() - truth) < 0.05
    assert (min_max_bands(a, _permutations(80), 32, 5)[0] == min_max_bands(a[::-1], _permutations(80), 32, 5)[0]).all()


def test_word_hashes_do_not_depend_on_place_or_spacing():
    def hashes(texts):
        raw = [t.encode() for t in texts]
        off = np.cumsum([0, *map(len, raw)])
        buf = np.frombuffer(b"".join(raw), np.uint8)
        s, e, rows = word_spans(buf, off, SPACED[0])
        h = word_hashes(buf, s, e, SPACED[1])
        return [h[a:b].tolist() for a, b in zip(rows[:-1], rows[1:])]

    one, two, three, four = hashes(["Ab cd", "ab\n cd ", "", "x" * 3_000_000 + " ab"])
    assert one == two and three == [] and four[1] == one[0]
    assert len(shingle_hashes(np.arange(3, dtype=U64), 5)) == 0


def test_bands_follow_the_percentage():
    from proofmill.llm.minmax import banding

    assert banding(80) == (32, 5)
    for percent in (50, 60, 70, 90, 95):
        bands, rows = banding(percent)
        assert bands * rows <= 160 and (1 - (percent / 100) ** rows) ** bands <= 4e-6


def test_bands_that_miss_pairs_are_refused(no_docs):
    with pytest.raises(ValueError):
        near_duplicates(no_docs, percent=50, bands=32, rows=5)


def test_members_that_cannot_share_enough_do_not_meet(spark):
    # 10 of 110 tokens outside the leader, of which each lacks 8 others: 220 * 0.8 / 1.8 - 92 = 5.8 of those outside must be shared
    tokens = {1: range(10), 2: [9, *range(100, 109)], 3: [*range(10, 14), 4, 5, 6, 7, 8, 9]}
    rows = [(False, 7, c, c, c, 110, 100, 1, 8, 255 << 8 * c, *[0] * (len(GONE) - 1), list(t)) for c, t in tokens.items()]
    names = ["cid", "label", "home", "n", "inside", "need", "lost", *GONE]
    sides = [spark.createDataFrame(rows, "at_home boolean, lead long, " + ", ".join(f"{c}_{x} long" for c in names) + ", tokens array<long>") for x in "ab"]
    met = Counter((r.cid_a, r.cid_b) for r in _meetings(*sides, 80).collect() if r.cid_a < r.cid_b)
    assert met == {(1, 3): 6}  # the first token of 2 is the last one of 1 and 3, so nothing can follow
