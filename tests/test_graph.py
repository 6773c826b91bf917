import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmill.operators import graph as G
from proofmill.operators import pairs as PR
from proofmill.operators import selection as SE
from proofmill.operators import similarity as SI


def jac(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def sets(spark):
    rnd = random.Random(5)
    base = [set(rnd.sample([f"t{i}" for i in range(40)], rnd.randint(1, 12))) for _ in range(60)]
    # a third of the rows are copies of one set, and many near copies share a token
    base += [set(base[0])] * 40 + [base[0] | {f"u{i}"} for i in range(20)]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(base)], "id int, tokens array<string>")
    return base, df


@pytest.mark.parametrize("t", [0.3, 0.6, 0.9])
def test_similarity_pairs_exact(sets, t):
    base, df = sets
    reps = {}
    for i, s in enumerate(base):
        reps.setdefault(frozenset(s), i)
    want = {(min(reps[a], reps[b]), max(reps[a], reps[b])) for a, b in itertools.combinations(reps, 2) if jac(a, b) >= t - 1e-12}
    pairs, member = SI.similarity_pairs(df, "id", "tokens", t, block=7)
    assert {(r.id_a, r.id_b) for r in pairs.collect()} == want
    assert member.count() == len(base)
    # copies: every pair of rows is counted, and no row loses a link
    linked = [(i, j) for i, j in itertools.combinations(range(len(base)), 2) if jac(base[i], base[j]) >= t - 1e-12]
    classes = SI.class_pairs(pairs, member, "id").collect()
    assert sum(r.n_pairs for r in classes) == len(linked)
    degree = {i: 0 for i in range(len(base))}
    for i, j in linked:
        degree[i] += 1
        degree[j] += 1
    assert {r.id: r.n_links for r in SI.row_links(pairs, member, df, "id").collect()} == degree
    groups = df.withColumn("g", F.col("id") % 3)
    crossed = SI.cross_group(pairs, member, groups, "id", "g").agg(F.sum("n_pairs")).first()[0]
    assert (crossed or 0) == sum((i - j) % 3 != 0 for i, j in linked)
    values = df.withColumn("v", F.col("id") % 5)
    cliffs = PR.cliffs(pairs, member, values, "id", "v", 2).collect()
    assert sum(r.n_pairs for r in cliffs) == sum(abs(i % 5 - j % 5) >= 2 for i, j in linked)


def test_one_text_in_a_third_of_the_rows_makes_no_row_pairs(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 3 = 0, array('a','b'), array(concat('x', id), concat('y', id))) as tokens")
    pairs, member = SI.similarity_pairs(df, "id", "tokens", 0.6)
    assert SI.class_pairs(pairs, member, "id").collect()[0].n_pairs == 1000 * 999 // 2
    assert SI.row_links(pairs, member, df, "id").agg(F.sum("n_links")).first()[0] == 1000 * 999


def test_top_neighbors_exact(sets):
    base, df = sets
    q, r = df.where("id % 3 = 0"), df.where("id % 3 <> 0")
    for k in (1, 3):
        got = {}
        report = []
        for x in SI.top_neighbors(q, r, "id", "tokens", k=k, ladder=(0.9, 0.6, 0.3, 0.0), block=7, report=report).collect():
            got.setdefault(x.id, []).append((x.rank, x.neighbor, round(x.similarity, 9)))
        asked = [step["queries"] for step in report]
        assert asked == sorted(asked, reverse=True) and asked[-1] < asked[0]  # queries leave the ladder on the way
        for i in range(0, len(base), 3):
            order = sorted(((-jac(base[i], base[j]), j) for j in range(len(base)) if j % 3 and base[i] & base[j]))[:k]
            have = sorted(got[i], key=lambda x: x[0])
            if not order:
                assert have == [(1, None, 0.0)]
                continue
            assert [round(-s, 9) for s, _ in order] == [s for _, _, s in have]
            if k == 1 and order:
                tied = min(j for s, j in order)
                assert have[0][1] == tied


def test_leave_one_out_never_finds_the_row_itself(sets):
    base, df = sets
    got = {}
    for x in SI.top_neighbors(df, df, "id", "tokens", k=2, exclude_self=True).collect():
        got.setdefault(x.id, []).append((x.rank, x.neighbor, round(x.similarity, 9)))
    for i in range(len(base)):
        order = sorted((-round(jac(base[i], base[j]), 9), j) for j in range(len(base)) if j != i and base[i] & base[j])[:2]
        assert sorted(got[i], key=lambda x: x[0]) == [(n + 1, j, -s) for n, (s, j) in enumerate(order)]


def test_nearest_other_row_is_searched_in_the_whole_table(spark, tmp_path):
    from proofmill.plans import load

    texts = {0: "a b c d", 1: "a b c d", 5: "a b x y", 7: "p q r", 200: "p q s t", 11: "u v", 300: "m n o", 20: "a b c d", 22: None, 400: "", 500: "p q r"}
    rows = [(i, x, len(x or "")) for i, x in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.neighbor, r.similarity) for r in load().QUERIES["nearest_neighbor_self"](spark, str(tmp_path)).collect()}
    words = {i: set((x or "").split()) for i, x in texts.items()}
    want = {}
    for i in (i for i in texts if i % 100 == 0):
        order = sorted((-round(jac(words[i], words[j]), 6), j) for j in texts if j != i and words[i] & words[j])
        want[i] = (order[0][1], -order[0][0]) if order else (None, 0.0)
    assert got == want
    assert got[0] == (1, 1.0) and got[500] == (7, 1.0)


def test_split_pairs_covers_hot_group(spark):
    df = spark.createDataFrame([("h", i) for i in range(50)] + [("x", 100), ("x", 101)], "k string, id int")
    p = SI.split_pairs(df, ["k"], "id", block=8)
    got = [(r.a.id, r.b.id) for r in p.collect()]
    assert len(got) == len(set(got)) == 50 * 49 // 2 + 1 and all(a < b for a, b in got)


def test_components_and_independent_set(spark):
    rnd = random.Random(1)
    edges = {(min(a, b), max(a, b)) for a, b in ((rnd.randrange(80), rnd.randrange(80)) for _ in range(60)) if a != b} | {(i, i + 1) for i in range(100, 130)}
    nodes = spark.createDataFrame([(i,) for i in [*range(80), *range(100, 131)]], "id int")
    e = spark.createDataFrame(sorted(edges), "id_a int, id_b int")
    lab = {i: i for i in [*range(80), *range(100, 131)]}
    for _ in range(200):
        for a, b in edges:
            lab[a] = lab[b] = min(lab[a], lab[b])
    assert {r.id: r.component for r in G.connected_components(nodes, e, "id").collect()} == lab
    pri = {i: (i * 37) % 211 for i in lab}
    kept: set = set()
    for i in sorted(lab, key=pri.get):
        if not any((min(i, j), max(i, j)) in edges for j in kept):
            kept.add(i)
    n = spark.createDataFrame(list(pri.items()), "id int, p int")
    assert {r.id for r in G.greedy_independent(n, e, "id", "p").collect()} == kept


def test_greedy_matching(spark):
    rnd = random.Random(2)
    pairs = {(rnd.randrange(15), rnd.randrange(15)): round(rnd.random(), 3) for _ in range(80)}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "l int, r int, s double")
    ul, ur, want = set(), set(), set()
    for (a, b), s in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        if a not in ul and b not in ur:
            want.add((a, b))
            ul.add(a)
            ur.add(b)
    got = {(x.l, x.r) for x in G.greedy_matching(df, "l", "r", [F.negate("s"), F.col("l"), F.col("r")]).collect()}
    assert got == want


def test_leader_clusters(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.9), (3, 4, 0.8)], "id_a int, id_b int, similarity double")
    nodes = spark.createDataFrame([(i, 1) for i in range(1, 6)], "id int, copies int")
    c = {r.id: r.leader for r in G.leader_clusters(nodes, pairs, "id").collect()}
    assert c == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    s = {r.leader: (r.cluster_size, r.medoid) for r in G.cluster_summary(spark.createDataFrame(list(c.items()), "id int, leader int"), pairs, nodes.selectExpr("id", "id as rep", "copies"), nodes.union(spark.createDataFrame([(9, 1)], nodes.schema)), "id").collect()}
    assert s[1] == (3, 1) and s[9] == (1, 9)


def test_rules_match_pair_table(spark):
    rnd = random.Random(9)
    d = spark.createDataFrame([(i, f"c{rnd.randrange(4)}", rnd.choice("xyz"), rnd.random(), 1) for i in range(80)], "id int, core string, fragment string, value double, core_size int")
    a = {(r.source_fragment, r.target_fragment): r for r in PR.mine_rules(d).collect()}
    b = {(r.source_fragment, r.target_fragment): r for r in PR.rules_from_pairs(PR.matched_pairs(d)).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k].support == b[k].support and abs(a[k].mean_delta - b[k].mean_delta) < 1e-9 and abs(a[k].sd_delta - b[k].sd_delta) < 1e-6


def test_quotas(spark):
    rows = [(i, f"s{i % 3}", float(i)) for i in range(30)]
    d = spark.createDataFrame(rows, "id int, series string, v double")
    cats = [("top", F.col("v") >= 10, [F.desc("v")], 4), ("rest", F.lit(True), [F.desc("v")], 10)]
    picks, summary = SE.quota_plan(d, "id", "series", cats, per_series=2)
    got = picks.toPandas()
    assert got.id.is_unique and got.groupby("series").size().max() <= 2
    assert {r.category: r.shortfall for r in summary.collect()} == {"top": 0, "rest": 8}


def test_matching_over_copies_uses_every_row(spark):
    r = random.Random(8)
    texts = [frozenset(r.sample("abcdefgh", r.randint(2, 4))) for _ in range(9)]
    rows = [(i, sorted(r.choice(texts[:3] if i % 2 else texts)), i % 3 != 0) for i in range(70)]
    df = spark.createDataFrame([(i, x, int(y)) for i, x, y in rows], "id int, tokens array<string>, y int")
    rep = {}
    for i, x, _ in rows:
        rep.setdefault(tuple(x), i)
    order = sorted((-round(jac(set(a), set(b)), 9), rep[tuple(a)], rep[tuple(b)], i, j) for i, a, p in rows for j, b, q in rows if p and not q and jac(set(a), set(b)) >= 0.3)
    seen, want = set(), []
    for s, ra, rb, i, j in order:  # one pair of rows after another
        if i not in seen and j not in seen:
            seen |= {i, j}
            want.append((ra, rb, -s))
    got = SI.matched_classes(df, "id", "tokens", "y", 0.3).collect()
    sets = {i: rep[tuple(x)] for i, x, _ in rows}
    assert sorted((sets[x.id_a], sets[x.id_b], round(x.similarity, 9)) for x in got) == sorted(want)
    ids = [k for x in got for k in (x.id_a, x.id_b)]
    assert len(ids) == len(set(ids))


def test_near_copies_meet_once(spark):
    """A pair is met at the first token it shares, not at every token of its prefixes."""
    rows = [(i, [f"w{j}" for j in range(100) if j != 50 + i]) for i in range(4)]
    df = spark.createDataFrame(rows, "rep int, tokens array<string>")
    o = SI.rarity_ordered(df)
    a, b = (SI._prefix(o, s, SI._standard(0.65)) for s in "ab")
    met = SI._blocked(a, b, 2).where("id_a < id_b").where(SI._first_meeting(0.65))
    assert met.select("id_a", "id_b").distinct().count() == 6
    assert met.count() <= 12  # 36 tokens a prefix


def test_sketches_lose_no_pair(spark):
    """Sketches of several lengths rule out pairs that share rare tokens only, and none that are similar."""
    rng = random.Random(4)
    rows, at = [], 0
    for n in (5, 40, 300, 700, 1500):
        base = [f"v{n}_{j}" for j in range(n)]
        for cut in (0.0, 0.1, 0.25, 0.6):
            keep = [w for w in base if rng.random() >= cut]
            rows.append((at, sorted(set(keep + [f"x{at}_{j}" for j in range(int(cut * 10))] + ["rare1", "rare2"]))))
            at += 1
    df = spark.createDataFrame(rows, "rep int, tokens array<string>")
    o = SI.rarity_ordered(df).cache()
    sets = {i: set(t) for i, t in rows}
    sim = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    cand = spark.createDataFrame([(i, j) for i, j in sim], "id_a int, id_b int")
    for t in (0.3, 0.65, 0.9):
        kept = {(r.id_a, r.id_b) for r in SI._sketched(cand, o, o, t).collect()}
        want = {p for p, s in sim.items() if s >= t}
        assert want <= kept
        assert {(r.id_a, r.id_b) for r in SI.similar_sets(o, t, block=3).collect()} == want
    assert len(kept) < len(sim) / 2  # sets of far lengths are kept


def test_searches_leave_out_no_reference_row(spark, tmp_path):
    """The nearest row of a query row may be a query row, in the plain search and in the domain."""
    from proofmill.plans import load

    rows = [(0, "a b c d e"), (100, "a b c d f"), (1, "a x y z w"), (2, "x y z v u"), (3, "x y z v t")]
    docs = spark.createDataFrame([(i, x, len(x)) for i, x in rows], "doc_id long, text string, n_chars int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.neighbor for r in load().QUERIES["nearest_neighbor"](spark, str(tmp_path)).collect()}
    assert got == {0: 100, 100: 0}
    inside = {r.doc_id: r.similarity for r in load().QUERIES["applicability_domain"](spark, str(tmp_path)).collect()}
    assert inside == {0: round(4 / 6, 6), 100: round(4 / 6, 6)}


def test_matched_pairs_keep_the_largest_core_and_carry_columns(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, f"c{rnd.randrange(4)}", f"f{rnd.randrange(3)}", float(rnd.randrange(50)), rnd.randrange(1, 4), f"x{i % 3}") for i in range(120)]
    rows += [(i, f"c{rnd.randrange(4)}", f"f{rnd.randrange(3)}", float(rnd.randrange(50)), rnd.randrange(1, 4), f"x{i % 3}") for i in range(0, 120, 3)]
    df = spark.createDataFrame(rows, "id int, core string, fragment string, value double, core_size int, ctx string")
    df = df.join(df.groupBy("core").agg(F.max("core_size").alias("s")), "core").drop("core_size").withColumnRenamed("s", "core_size")
    size = {r.core: r.core_size for r in df.collect()}
    best = {}
    for a, b in itertools.product(rows, rows):
        if a[0] < b[0] and a[1] == b[1] and a[2] != b[2] and abs(a[3] - b[3]) >= 10:
            k = (a[0], b[0])
            best[k] = min(best.get(k, (9, "")), (-size[a[1]], a[1]))
    monkeypatch.setattr(SI, "TASK_PAIRS", 100)
    p = PR.matched_pairs(df, min_delta=10.0, carry=("ctx",))
    got = p.collect()
    assert len(got) == len(best) and {(r.id_a, r.id_b): (-r.core_size, r.core) for r in got} == best
    assert all(r.ctx_a == f"x{r.id_a % 3}" and r.ctx_b == f"x{r.id_b % 3}" for r in got)
    # tasks follow the pairs, not the bytes of the rows that make them
    assert p.rdd.getNumPartitions() > 20


def test_carried_columns_give_what_joins_of_pairs_give(spark):
    from proofmill.operators import joins as J

    rnd = random.Random(5)
    f = spark.createDataFrame([(i, f"c{i % 3}", f"f{rnd.randrange(3)}", float(rnd.randrange(50)), 1, rnd.choice(["p", "q", "", None])) for i in range(40)], "id int, core string, fragment string, value double, core_size int, ctx string")
    obs = spark.createDataFrame([(i, e, float(rnd.randrange(9)), 0.0, 9.0) for i in range(0, 40) for e in "AN" if rnd.random() < 0.6], "id int, ep string, value double, lower double, upper double")
    rows = lambda d: sorted(map(tuple, d.collect()))
    plain = PR.matched_pairs(f, min_delta=5.0)
    e = PR.carried_evidence(PR.matched_pairs(PR.with_evidence(f, obs, "id", "ep"), min_delta=5.0, carry=("evidence",)), "ep")
    assert rows(e) == rows(PR.pair_evidence(plain, obs, "id", "ep")) != []
    want = J.pair_context(plain.select("id_a", "id_b"), f, "id_a", "id_b", "id", {"ctx": "same"})
    got = J.carried_context(PR.matched_pairs(J.with_contexts(f, f, "id", ["ctx"]), min_delta=5.0, carry=("contexts_ctx",)), {"ctx": "same"})
    assert rows(got.select(want.columns)) == rows(want) and {r[-1] for r in rows(want)} == {"same", "cross_context"}
    one = PR.prediction_means(obs, "id", "value", "upper")
    d = PR.carried_directions(PR.matched_pairs(f.join(one, "id"), min_delta=5.0, carry=("o", "p")))
    assert rows(d) == rows(PR.direction_table(plain, obs, "id", "value", "upper")) != []


def test_blocked_search_equals_brute_force(spark, monkeypatch):
    """Several blocks of queries and batches of references, ties, rows alike and rows with nothing shared; codes with and without a dense column."""
    rng = random.Random(9)
    base = [set(rng.sample([f"t{int(j ** 1.5)}" for j in range(60)], rng.randint(1, 15))) for _ in range(120)]
    base += [set(base[3]), set(base[3]), {"alone"}, {f"z{j}" for j in range(30)}, {f"z{j}" for j in range(28)}]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(base)], "id int, tokens array<string>")
    for name, value in {"QUERY_ROWS": 16, "DENSE": 5, "ROWS": 7, "MEETINGS": 50, "SPREAD": 3}.items():
        monkeypatch.setattr(SI, name, value)
    got = {}
    for x in SI.top_neighbors(df, df, "id", "tokens", k=3, exclude_self=True, block=40).collect():
        got.setdefault(x.id, []).append((x.rank, x.neighbor, round(x.similarity, 9)))
    for i in range(len(base)):
        order = sorted((-round(jac(base[i], base[j]), 9), j) for j in range(len(base)) if j != i and base[i] & base[j])[:3]
        assert sorted(got[i]) == ([(n + 1, j, -s) for n, (s, j) in enumerate(order)] or [(1, None, 0.0)])


def test_search_moves_no_references(spark):
    """Neither a join by token nor the sets themselves are shuffled in a pass over the references."""
    rows = [(i, [1, i % 7 + 2], 2) for i in range(50)]
    r = spark.createDataFrame(rows, "rep int, tokens array<int>, n int")
    got = SI._compared(r.withColumn("s", F.lit(1e-7)), r, 2, 16)
    assert got.count() == 100 and got.where("rank = 1 and id_a % 7 = id_b % 7").count() == 50
    assert got.agg(F.min("pairs"), F.max("pairs")).first() == (50, 50)


def test_votes_are_for_every_row(spark, tmp_path):
    """the voted rows were those with doc_id % 100 = 0."""
    from proofmill.plans import load

    rows = [(i, x, len(x)) for i, x in ((1, "a b c"), (2, "a b d"), (100, "a b c d"), (7, "z"))]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_neighbors for r in load().QUERIES["neighbor_vote"](spark, str(tmp_path)).collect()}
    assert got == {1: 2, 2: 2, 100: 2}


def test_ranks_fall_back_to_a_join(spark, monkeypatch):
    """More tokens than a task may hold: the same pairs by the other way."""
    rng = random.Random(2)
    base = [set(rng.sample([f"t{j}" for j in range(25)], rng.randint(1, 9))) for _ in range(40)]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(base)], "id int, tokens array<string>")
    pairs = lambda: {(x.id_a, x.id_b, round(x.similarity, 9)) for x in SI.similarity_pairs(df, "id", "tokens", 0.3)[0].collect()}
    want = pairs()
    monkeypatch.setattr(SI, "TABLE_TOKENS", 3)
    assert pairs() == want and want
