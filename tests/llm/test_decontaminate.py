import hashlib
import random
import re
from collections import Counter

from proofmill.llm.decontaminate import contamination, drop_contaminated
from tests.llm.conftest import prose


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(rows, items, window=10):
    wins = {}
    for key, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(key)
    out = Counter()
    for key, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        names = sorted(str(x) for x in found if x is not None)
        out[key, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)] += 1
    return out


def result(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def table(spark, items):
    return spark.createDataFrame([(*x, 7) for x in items], "item_id long, text string, words int")


def test_against_brute_force(spark, edge_docs, edge_rows):
    by = dict(x for x in edge_rows if x[0] is not None)
    items = [(1, prose(1, 40)), (2, " ".join(by[6].split()[20:45]).upper()), (3, "two words"), (4, "one"), (5, None), (6, ""), (None, prose(1, 120)), (10, prose(3, 30000)[5000:5400]), (2, "loose words here"), (11, "日本語")]
    bench = table(spark, items)
    assert result(contamination(edge_docs, bench)) == expected(edge_rows, items)
    left = drop_contaminated(edge_docs, bench)
    assert left.columns == edge_docs.columns
    clean = {k for k, _, n, *_ in expected(edge_rows, items) if k is not None and not n}
    assert {r.doc_id for r in left.collect() if r.doc_id is not None} == clean


def test_planted_passages_at_both_ends_and_common_words(spark):
    r = random.Random(4)
    few = lambda n: " ".join(r.choice(("a", "b", "c")) for _ in range(n))
    items = [(i, few(14)) for i in range(8)] + [(20, prose(77, 30))]
    rows = [(i, few(120)) for i in range(40)] + [(100, prose(77, 30)), (101, "x " + prose(77, 30)), (102, prose(77, 30) + " x"), (103, prose(77, 9)), (104, prose(77, 10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(contamination(docs, table(spark, items))) == expected(rows, items)


def test_empty_tables(spark, edge_docs, edge_rows, no_docs):
    none = table(spark, [(1, None)]).limit(0)
    assert contamination(no_docs, none).count() == 0
    got = contamination(edge_docs, none)
    assert got.count() == len(edge_rows) and got.where("contaminated").count() == 0
    assert drop_contaminated(edge_docs, none).count() == len(edge_rows)


def test_rows_without_or_with_shared_keys_are_judged_one_by_one(spark):
    rows = [(None, prose(1, 30)), (None, prose(2, 30)), (None, None), (7, prose(1, 40)), (7, prose(3, 30)), (8, prose(4, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = drop_contaminated(docs, table(spark, [(1, prose(1, 30))]))
    assert Counter(map(tuple, left.collect())) == Counter(x for x in rows if not (x[1] or "").startswith(prose(1, 30)))
