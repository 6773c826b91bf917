"""Cardinality-checked joins, pair context, evidence pairing and small theta joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.operators.ranking import null_safe_join


class CardinalityError(ValueError):
    pass


def assert_unique(df: DataFrame, keys, name: str) -> None:
    """Fail when a key repeats; stops at the first offending group."""
    bad = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if bad:
        raise CardinalityError(f"{name} repeats key {[bad[0][k] for k in keys]}")


def checked_join(left: DataFrame, right: DataFrame, on, how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """Equi-join after asserting the promised side(s) are unique on the key."""
    on = [on] if isinstance(on, str) else list(on)
    if validate in ("one_to_one", "one_to_many"):
        assert_unique(left, on, "left side")
    if validate in ("one_to_one", "many_to_one"):
        assert_unique(right, on, "right side")
    return left.join(right, on, how)


def enrich(left: DataFrame, right: DataFrame, on, defaults: dict) -> DataFrame:
    """Left join with defaults for absent rows."""
    return left.join(right, on, "left").fillna(defaults)


def matched_cells(df: DataFrame, cells, subgroup: str, levels: int) -> DataFrame:
    """Rows of cells that hold at least ``levels`` subgroup levels."""
    lv = df.select(*cells, subgroup).distinct().groupBy(*cells).agg(F.count(F.lit(1)).alias("__l"))
    return null_safe_join(df, lv.where(F.col("__l") >= levels), list(cells)).drop("__l")


def pair_context(pairs: DataFrame, contexts: DataFrame, a: str, b: str, key: str, levels: dict) -> DataFrame:
    """Grade pairs by the strongest shared context.

    ``levels``: ordered {context column: grade}; the rest is ``cross_context``.  Shared values are found by
    joining on (pair, value), never by building per-subject sets of unbounded size.
    """
    out = pairs
    chain = None
    for column, grade in levels.items():
        vals = contexts.where(F.col(column).isNotNull() & (F.col(column) != "")).select(key, column).distinct()
        left = pairs.select(a, b).join(vals.withColumnRenamed(key, a), a)
        hit = left.join(vals.withColumnRenamed(key, b), [b, column]).select(a, b).distinct()
        out = out.join(hit.withColumn(f"shared_{column}", F.lit(True)), [a, b], "left").fillna({f"shared_{column}": False})
        cond = F.col(f"shared_{column}")
        chain = F.when(cond, grade) if chain is None else chain.when(cond, grade)
    return out.withColumn("context_grade", chain.otherwise("cross_context"))


def with_contexts(df: DataFrame, contexts: DataFrame, key: str, columns) -> DataFrame:
    """Rows with the distinct, non-blank values of each context column that their key has, as arrays."""
    named = lambda c: F.when(F.col(c) != "", F.col(c))
    sets = contexts.groupBy(key).agg(*[F.collect_set(named(c)).alias(f"contexts_{c}") for c in columns])  # bounded by one key's own rows
    return df.join(sets, key, "left")


def carried_context(pairs: DataFrame, levels: dict) -> DataFrame:
    """:func:`pair_context` of pairs that carry both sides' ``contexts_<column>``."""
    shared = {f"shared_{c}": F.coalesce(F.arrays_overlap(f"contexts_{c}_a", f"contexts_{c}_b"), F.lit(False)) for c in levels}
    out = pairs.withColumns(shared)
    chain = None
    for column, grade in levels.items():
        cond = F.col(f"shared_{column}")
        chain = F.when(cond, grade) if chain is None else chain.when(cond, grade)
    return out.withColumn("context_grade", chain.otherwise("cross_context"))


def nearest_choice(df: DataFrame, keys, column: str, target: float, tie: str) -> DataFrame:
    """One row per key: the one whose ``column`` is nearest the target."""
    cols = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*cols), F.struct(F.round(F.abs(F.col(column) - target), 9), F.col(tie)))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def expand_requests(items: DataFrame, requests) -> DataFrame:
    """Every item with every request of a fixed request list."""
    arr = F.array(*[F.struct(F.lit(n).alias("request"), F.lit(p).alias("priority")) for n, p in requests])
    return items.withColumn("r", F.explode(arr)).select(*items.columns, "r.request", "r.priority")


def factor_scenarios(df: DataFrame, target: str, levels, tolerance: float) -> DataFrame:
    """Grid points (a, b, c) whose product is within tolerance of each row's target.

    The grid is a fixed list of at most len(levels)**3 points, filtered inside the row.
    """
    grid = [(a, b, c) for a in levels for b in levels for c in levels]
    arr = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(a * b * c).alias("product")) for a, b, c in grid])
    near = F.filter(arr, lambda g: F.abs(g["product"] - F.col(target)) <= tolerance)
    return df.withColumn("g", F.explode(near)).select(*df.columns, "g.*")


def equal_weight_ensemble(df: DataFrame, keys, mean: str, sigma: str) -> DataFrame:
    """Mean of members and moment-matched variance; keys whose observed values disagree are flagged."""
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_members"),
        F.avg(mean).alias("mean"),
        F.avg(F.col(sigma) * F.col(sigma) + F.col(mean) * F.col(mean)).alias("__m2"),
        F.stddev_pop(mean).alias("member_sd"),
        (F.min("observed") == F.max("observed")).alias("observed_agrees"),
    )
    return g.withColumn("sigma", F.sqrt(F.greatest(F.lit(0.0), F.col("__m2") - F.col("mean") * F.col("mean")))).drop("__m2")


def holdout_clean(train: DataFrame, validation: DataFrame, key: str, label: str) -> DataFrame:
    """Drop train keys that carry conflicting labels or occur in validation; report why."""
    g = train.groupBy(key).agg(F.min(label).alias("lo"), F.max(label).alias("hi"), F.count(F.lit(1)).alias("n_rows"))
    seen = validation.select(key).distinct().withColumn("__v", F.lit(True))
    j = g.join(seen, key, "left")
    return j.select(
        key,
        "n_rows",
        F.when(F.col("lo") < F.col("hi"), "label_conflict").when(F.col("__v"), "validation_overlap").otherwise("kept").alias("status"),
    )


def dose_pairs(df: DataFrame, column: str) -> DataFrame:
    """Distinct (first, second) number pairs of ``a/b | c/d`` text, in order of appearance."""
    num = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)"
    seg = F.transform(F.split(F.coalesce(column, F.lit("")), r"\|"), lambda s: F.trim(s))
    good = F.filter(seg, lambda s: s.rlike(rf"^{num}\s*/\s*{num}$"))
    pairs = F.transform(
        good, lambda s: F.struct(F.trim(F.split(s, "/")[0]).cast("double").alias("first"), F.trim(F.split(s, "/")[1]).cast("double").alias("second"))
    )
    keep = [c for c in df.columns]
    return df.select(*keep, F.posexplode(F.array_distinct(pairs)).alias("position", "p")).select(*keep, "position", "p.first", "p.second")


def panel_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows of ``15%@10uM and >45%@30uM`` panels: relation, response, concentration, unit."""
    num = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)"
    pat = rf"(?i)([<>≤≥~≈]?)\s*({num})\s*%?\s*@\s*({num})\s*([numµμ]?M)"
    arrays = [F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(pat), F.lit(i)) for i in range(1, 5)]
    z = F.arrays_zip(*[a.alias(n) for a, n in zip(arrays, ("rel", "resp", "conc", "unit"))])
    d = df.select(*df.columns, F.posexplode(z).alias("position", "z"))
    rel = F.when(F.col("z.rel") == "", "=").otherwise(F.translate("z.rel", "≈", "~"))
    return d.select(
        *df.columns,
        "position",
        F.when(rel == "≤", "<=").when(rel == "≥", ">=").otherwise(rel).alias("relation"),
        F.col("z.resp").cast("double").alias("response"),
        F.col("z.conc").cast("double").alias("concentration"),
        F.translate("z.unit", "µμ", "uu").alias("unit"),
    )


def expand_evidence(df: DataFrame, values: str, sources: str) -> DataFrame:
    """Zip ``a | b`` with ``s1, s2``: equal lengths pair up, one value with many sources stays one
    row, anything else is unresolved and never guessed."""
    v = F.transform(F.split(F.coalesce(values, F.lit("")), r"\|"), lambda x: F.trim(x))
    s = F.filter(F.transform(F.split(F.coalesce(sources, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    d = df.withColumns({"__v": v, "__s": s})
    nv, ns = F.size("__v"), F.size("__s")
    matched = (nv == ns) & (ns > 0)
    bundle = (nv == 1) & (ns > 0)
    d = d.select(*df.columns, "__s", nv.alias("__nv"), ns.alias("__ns"), F.posexplode("__v").alias("position", "value"))
    matched = (F.col("__nv") == F.col("__ns")) & (F.col("__ns") > 0)
    bundle = (F.col("__nv") == 1) & (F.col("__ns") > 0)
    locator = F.when(matched, F.try_element_at("__s", F.col("position") + 1)).when(bundle, F.concat_ws(" | ", "__s"))
    return d.select(
        *df.columns, "position", "value", locator.alias("locator"), F.when(matched | bundle, "resolved").otherwise("unresolved").alias("pairing")
    )


def join_events(events: DataFrame, observations: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """(joined, issues): resolved observations meet events on all keys; the rest become issues."""
    ready = observations.where(F.col("pairing") == "resolved")
    joined = ready.join(events, list(keys))
    miss = ready.join(events.select(*keys).distinct(), list(keys), "left_anti").withColumn("issue", F.lit("no_matching_event"))
    bad = observations.where(F.col("pairing") != "resolved").withColumn("issue", F.lit("unresolved_source"))
    return joined, miss.unionByName(bad)


def apply_rules(parents: DataFrame, rules: DataFrame, visited: DataFrame, *, per_parent: int) -> DataFrame:
    """Swap a parent's fragment by mined rules; best support per product, visited ones removed, top-k."""
    j = parents.join(rules, parents.fragment == rules.source_fragment)
    j = j.withColumn("product", F.concat_ws("|", "core", "target_fragment"))
    best = j.groupBy("parent", "product").agg(F.max(F.struct("support", F.col("target_fragment"))).alias("b"))
    best = best.select("parent", "product", F.col("b.support").alias("support"), F.col("b.target_fragment").alias("target_fragment"))
    fresh = best.join(visited.select("product").distinct(), "product", "left_anti")
    rn = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("support"), "product"))
    return fresh.withColumn("rank", rn).where(F.col("rank") <= per_parent)


def unique_pivot(df: DataFrame, key: str, name: str, value: str, names) -> DataFrame:
    """One column per name; two values for one key and name are an error, never silently merged."""

    def only(n):
        here = F.col(name) == n
        many = F.raise_error(F.concat(F.lit(f"several values of {n} for "), F.col(key).cast("string")))
        return F.when(F.count_if(here) > 1, many).otherwise(F.max(F.when(here, F.col(value)))).alias(n)

    return df.groupBy(key).agg(*[only(n) for n in names])
