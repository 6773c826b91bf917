"""Components, leader clusters and matchings as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.functions.text import stable_id
from proofmill.session import cut_lineage


def connected_components(nodes: DataFrame, edges: DataFrame, key: str, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(key, component): the smallest key of each component.

    Every round takes the smallest label among neighbours, then jumps to the label's own label, so
    long chains close in logarithmically many rounds.  A hub only contributes to a minimum.
    """
    both = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).unionAll(edges.select(F.col(b), F.col(a)))
    both = cut_lineage(both.distinct())
    lab = cut_lineage(nodes.select(F.col(key).alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        msg = both.join(lab, both.src == lab.node).groupBy("dst").agg(F.min("label").alias("m"))
        near = lab.join(msg, lab.node == msg.dst, "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        hop = lab.select(F.col("node").alias("h"), F.col("label").alias("hl"))
        nxt = near.join(hop, near.label == hop.h, "left").select("node", "old", F.least("label", "hl").alias("label"))
        nxt = cut_lineage(nxt)
        moved = nxt.where(F.col("old") != F.col("label")).limit(1).count()
        lab = nxt.select("node", "label")
        if not moved:
            return lab.select(F.col("node").alias(key), F.col("label").alias("component"))


def component_topology(components: DataFrame) -> DataFrame:
    """Component count, effective count, largest and singletons: one row."""
    s = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return s.agg(
        F.count(F.lit(1)).alias("n_components"),
        (F.sum("n").cast("double") * F.sum("n") / F.sum(F.col("n").cast("double") * F.col("n"))).alias("effective_components"),
        F.max("n").alias("largest_component"),
        F.count_if(F.col("n") == 1).alias("singletons"),
    )


def greedy_independent(nodes: DataFrame, edges: DataFrame, key: str, priority: str, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """Keys kept by walking down ``priority`` (small first) and skipping anything adjacent to a kept one.

    ``priority`` must be unique.  In each round every undecided node that precedes all its undecided
    neighbours is kept; the result equals the sequential walk.
    """
    p = nodes.select(F.col(key).alias("node"), F.col(priority).alias("p"))
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionAll(edges.select(F.col(b), F.col(a)))
    live = cut_lineage(both.distinct())
    state = cut_lineage(p)
    kept = None
    while True:
        lp = live.join(state.select(F.col("node").alias("y"), F.col("p").alias("py")), "y")
        best = lp.groupBy("x").agg(F.min("py").alias("m"))
        ahead = state.join(best, state.node == best.x, "left").where(F.col("m").isNull() | (F.col("p") < F.col("m"))).select("node")
        ahead = cut_lineage(ahead)
        kept = ahead if kept is None else kept.unionAll(ahead)
        gone = ahead.unionAll(live.join(ahead, live.x == ahead.node).select(F.col("y").alias("node"))).distinct()
        state = cut_lineage(state.join(gone, "node", "left_anti"))
        if state.isEmpty():
            return kept.select(F.col("node").alias(key))
        keep = state.select("node")
        live = live.join(keep.withColumnRenamed("node", "x"), "x", "left_semi").join(keep.withColumnRenamed("node", "y"), "y", "left_semi")
        live = cut_lineage(live)


def leader_clusters(nodes: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, leader) of classes, ``nodes`` with their number of ``copies``: nodes with most neighbours lead; others join their best-placed adjacent leader.

    Neighbour counts are fixed up front (the variant without re-counting after each pick).
    """
    from proofmill.operators.ranking import ordered_index

    both = pairs.select(F.col("id_a").alias("x"), F.col("id_b").alias("y")).unionAll(pairs.select("id_b", "id_a"))
    n = nodes.select(key, "copies").distinct()
    deg = both.join(n.select(F.col(key).alias("y"), "copies"), "y").groupBy("x").agg(F.sum("copies").alias("deg"))
    n = n.join(deg, n[key] == deg.x, "left").select(key, F.negate(F.coalesce("deg", F.lit(0)) + F.col("copies") - 1).alias("nd"))
    order = cut_lineage(ordered_index(n, "nd", key, "place").select(key, "place"))
    lead = cut_lineage(greedy_independent(order, pairs, key, "place"))
    adj = both.join(lead, both.y == lead[key]).select("x", F.col("y").alias("l"))
    adj = adj.join(order.select(F.col(key).alias("l"), "place"), "l")
    own = adj.groupBy("x").agg(F.min_by("l", "place").alias("leader"))
    j = order.select(key).join(own, F.col(key) == F.col("x"), "left").join(lead.select(F.col(key).alias("is_lead")), F.col(key) == F.col("is_lead"), "left")
    return j.select(key, F.when(F.col("is_lead").isNotNull(), F.col(key)).otherwise(F.col("leader")).alias("leader"))


def cluster_summary(clusters: DataFrame, pairs: DataFrame, member: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Per leader over all rows: size, medoid (largest total similarity, ties lowest key), content id of the member set.

    ``clusters`` has a leader for each class; ``member`` gives each row's class; a row without a class is its own cluster.
    """
    c = clusters.select(F.col(key).alias("rep"), "leader").join(member.where(F.col(key) == F.col("rep")).select("rep", "copies"), "rep")
    ca, cb = (c.select(F.col("rep").alias(f"id_{x}"), F.col("leader").alias(f"l{x}"), F.col("copies").alias(f"n{x}")) for x in "ab")
    inside = pairs.join(ca, "id_a").join(cb, "id_b").where("la = lb")
    s = F.col("similarity")
    tot = inside.select(F.col("id_a").alias("m"), (s * F.col("nb")).alias("s")).unionAll(inside.select("id_b", s * F.col("na"))).groupBy("m").agg(F.sum("s").alias("s"))
    d = c.join(tot, c.rep == tot.m, "left").withColumn("s", F.round(F.coalesce("s", F.lit(0.0)) + F.col("copies") - 1, 9))
    best = d.groupBy("leader").agg(F.min_by("rep", F.struct(F.negate("s"), F.col("rep"))).alias("medoid"))
    every = member.select(key, "rep").join(c.select("rep", "leader"), "rep").select(key, "leader")
    every = rows.select(key).join(every, key, "left").select(key, F.coalesce("leader", key).alias("leader"))
    h = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    # the member set is digested by an order-free sum, so no member list is ever built
    g = every.groupBy("leader").agg(F.count(F.lit(1)).alias("cluster_size"), F.sum(h).cast("string").alias("member_sum")).join(best, "leader", "left")
    return g.select("leader", "cluster_size", F.coalesce("medoid", "leader").alias("medoid"), stable_id("CLU", ["cluster_size", "member_sum"], 16).alias("cluster_id"))


def greedy_matching(pairs: DataFrame, a: str, b: str, order) -> DataFrame:
    """Pairs taken best first with every id used at most once; rounds of mutually best pairs.

    ``order`` is a list of sort columns that is total over the pairs.
    """
    key = F.struct(*[o if not isinstance(o, str) else F.col(o) for o in order])
    live = cut_lineage(pairs.withColumn("__k", key))
    out = None
    while True:
        ends = live.select(F.concat(F.lit("a"), F.col(a).cast("string")).alias("e"), "__k").unionAll(
            live.select(F.concat(F.lit("b"), F.col(b).cast("string")), "__k")
        )
        best = ends.groupBy("e").agg(F.min("__k").alias("m"))
        ba = best.where(F.col("e").startswith("a")).select(F.substr("e", F.lit(2)).alias("ea"), F.col("m").alias("ma"))
        bb = best.where(F.col("e").startswith("b")).select(F.substr("e", F.lit(2)).alias("eb"), F.col("m").alias("mb"))
        j = live.join(ba, F.col(a).cast("string") == F.col("ea")).join(bb, F.col(b).cast("string") == F.col("eb"))
        take = cut_lineage(j.where((F.col("__k") == F.col("ma")) & (F.col("__k") == F.col("mb"))).select(*live.columns))
        if take.isEmpty():
            res = out if out is not None else live.limit(0)
            return res.drop("__k")
        out = take if out is None else out.unionByName(take)
        live = cut_lineage(live.join(take.select(a), a, "left_anti").join(take.select(b), b, "left_anti"))


def capacity_matching(pairs: DataFrame, a: str, b: str, places_a: DataFrame, places_b: DataFrame, order) -> DataFrame:
    """``pairs`` with ``units``, ``start_a``, ``start_b``: pairs taken best first, each as often as both ends have places left.

    ``places_a`` (a, places) and ``places_b`` say how often an end can be matched; ``order`` is total over the pairs.  In a round
    every pair that is the best of both its ends is taken; one of them is then used up, so the result is that of the sequential
    walk.  ``start_*`` counts the places of an end that earlier pairs took.
    """
    key = F.struct(*[o if not isinstance(o, str) else F.col(o) for o in order])
    live = pairs.join(places_a.select(a, F.col("places").cast("long").alias("left_a")), a).join(places_b.select(b, F.col("places").cast("long").alias("left_b")), b)
    live = cut_lineage(live.withColumns({"__k": key, "start_a": F.lit(0).cast("long"), "start_b": F.lit(0).cast("long")}).where("left_a > 0 and left_b > 0"))
    out = None
    while True:
        best_a = live.groupBy(a).agg(F.min("__k").alias("__ka"))
        best_b = live.groupBy(b).agg(F.min("__k").alias("__kb"))
        take = live.join(best_a, a).join(best_b, b).where("__k = __ka and __k = __kb").withColumn("units", F.least("left_a", "left_b"))
        take = cut_lineage(take.drop("__ka", "__kb"))
        if take.isEmpty():
            res = out if out is not None else live.limit(0).withColumn("units", F.lit(0).cast("long"))
            return res.select(*pairs.columns, "units", "start_a", "start_b")
        out = take if out is None else out.unionByName(take)
        used_a, used_b = take.select(a, F.col("units").alias("ua")), take.select(b, F.col("units").alias("ub"))
        gone = take.select(F.col(a).alias("__a"), F.col(b).alias("__b"))
        live = live.join(gone, (F.col(a) == F.col("__a")) & (F.col(b) == F.col("__b")), "left_anti").join(used_a, a, "left").join(used_b, b, "left")
        ua, ub = F.coalesce("ua", F.lit(0)), F.coalesce("ub", F.lit(0))
        live = live.withColumns({"left_a": F.col("left_a") - ua, "left_b": F.col("left_b") - ub, "start_a": F.col("start_a") + ua, "start_b": F.col("start_b") + ub}).drop("ua", "ub")
        live = cut_lineage(live.where("left_a > 0 and left_b > 0"))
