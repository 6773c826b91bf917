"""Subject-level aggregation and labelled collapses of measurement tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions.text import blank_to_null
from proofmill.functions.values import ladder, lookup
from proofmill.operators.gates import apply_censoring_policy
from proofmill.operators.ranking import cut_points, group_quantiles, null_safe_join, quantile_of, rank_cells

# Class cut points on the scaled value and their names.
CLASS_CUTS = (100, 1000, 10000)
CLASS_NAMES = ("class_1_le_100", "class_2_le_1000", "class_3_le_10000", "class_4_gt_10000")


def joined_uniques(df: DataFrame, keys, columns: dict) -> DataFrame:
    """Sorted distinct non-blank values per key for several columns, ``;``-joined, one shuffle.

    ``columns`` maps output name to input column.  Repeats are removed map-side; the lists are whole,
    so a row is as long as its key has distinct values (use the distinct (key, value) rows where that
    is not bounded).
    """
    keys = list(keys)
    fields = F.array(
        *[F.struct(F.lit(n).alias("f"), blank_to_null(c).alias("v")) for n, c in columns.items()]
    )
    long = df.select(*keys, F.explode(fields).alias("x")).select(*keys, "x.f", "x.v")
    long = long.where(F.col("v").isNotNull()).distinct()
    one = long.groupBy(*keys).agg(
        *[
            F.concat_ws(";", F.array_sort(F.collect_list(F.when(F.col("f") == n, F.col("v"))))).alias(n)
            for n in columns
        ]
    )
    return one


def aggregate_subjects(
    df: DataFrame,
    *,
    by=("subject_id",),
    policy: str = "strict_exact",
    eligible_only: bool = True,
    spread_threshold: float = 1.0,
    cuts=None,
) -> DataFrame:
    """One row per stratum with counts, exact medians, extremes, context sets and a class.

    Rows are first collapsed to (stratum, value) cells, so the second shuffle carries distinct
    values only; medians, extremes, counts and sets then come from one aggregate over the ranked
    cells.  The p-scale falls as the value rises, so its median uses the same two middle cells.
    ``cuts`` (any ascending numbers on the value axis) only balance the ranking.
    """
    by = list(by)
    data = df.where(
        F.col("is_core_endpoint") & (F.col("value_scaled") > 0) & F.col("p_value").isNotNull()
    )
    if eligible_only:
        data = data.where(F.col("is_eligible"))
    data = apply_censoring_policy(data, policy, by)
    cuts = cut_points(data, "value_scaled") if cuts is None else cuts
    keep = ~F.coalesce(F.col("is_mirror_redundant"), F.lit(False))

    def kept(c) -> Column:
        return F.when(keep, F.col(c).cast("string"))

    sets = ("relation", "endpoint", "family", "yr")
    cells = data.groupBy(*by, "value_scaled").agg(
        F.count(F.lit(1)).alias("__rows"),
        F.count_if(keep).alias("n_tied"),
        F.count_if(keep & F.col("is_exact")).alias("__exact"),
        F.count_if(keep & F.col("is_censored")).alias("__cens"),
        F.count_if(keep & (F.col("relation") == "~")).alias("__approx"),
        F.max("p_value").alias("p_value"),
        F.collect_set("source").alias("__set_source"),
        *[F.collect_set(kept(c)).alias(f"__set_{c}") for c in sets],
    )
    ranked = rank_cells(cells, "value_scaled", by, ("n",), cuts)
    live = F.col("n_tied") > 0

    def union(c) -> Column:
        # fixed vocabularies: few distinct subsets exist, so this state stays small
        return F.array_sort(F.array_distinct(F.flatten(F.collect_set(f"__set_{c}"))))

    agg = ranked.groupBy(*by).agg(
        F.sum("__rows").alias("n_source_rows"),
        F.sum(F.col("__rows") - F.col("n_tied")).alias("n_mirror_rows_collapsed"),
        F.sum("n_tied").alias("n_measurements"),
        F.sum("__exact").alias("n_exact"),
        F.sum("__cens").alias("n_censored"),
        F.sum("__approx").alias("n_approximate"),
        quantile_of("value_scaled", 0.5).alias("value_median"),
        # lower and upper middle swap on the inverted scale; their mean does not care
        ((quantile_of("p_value", 0.5, "lower") + quantile_of("p_value", 0.5, "higher")) / 2).alias("p_median"),
        F.max(F.when(live, F.col("p_value"))).alias("p_best"),
        F.min(F.when(live, F.col("p_value"))).alias("p_min"),
        F.min(F.when(live, F.col("value_scaled"))).alias("value_best"),
        union("source").alias("__sources"),
        *[union(c).alias(f"__{c}s") for c in sets],
    ).where(F.col("n_measurements") > 0)
    spread = F.col("p_best") - F.col("p_min")
    n_families = F.size("__familys").cast("long")
    return agg.withColumns(
        {
            "sources": F.concat_ws(";", "__sources"),
            "n_sources": F.size("__sources").cast("long"),
            "relations": F.concat_ws(";", "__relations"),
            "endpoints": F.concat_ws(";", "__endpoints"),
            "families": F.concat_ws(";", "__familys"),
            "n_families": n_families,
            "years": F.concat_ws(";", "__yrs"),
            "spread": spread,
            "is_heterogeneous": (spread > spread_threshold) | (n_families > 1),
            "semantics": F.when(F.col("n_exact") == F.col("n_measurements"), "exact_point_estimate")
            .when(F.col("n_censored") == F.col("n_measurements"), "censoring_thresholds_only")
            .when(F.col("n_approximate") == F.col("n_measurements"), "approximate_points_only")
            .otherwise("mixed_points_and_thresholds"),
            "value_class": ladder("value_median", CLASS_CUTS, CLASS_NAMES),
        }
    ).drop("__sources", *[f"__{c}s" for c in sets])


def dead_zone_label(df: DataFrame, value: str, positive_max: float, negative_min: float, out: str = "label") -> DataFrame:
    """1 at or below positive_max, 0 at or above negative_min, NULL in between."""
    v = F.col(value)
    return df.withColumn(out, F.when(v <= positive_max, 1).when(v >= negative_min, 0).cast("int"))


def conflict_free_labels(df: DataFrame, key: str, label: str) -> DataFrame:
    """One label per key; keys carrying more than one label are dropped, with counts kept."""
    g = df.where(F.col(label).isNotNull()).groupBy(key).agg(
        F.min(label).alias("__lo"), F.max(label).alias("__hi"), F.count(F.lit(1)).alias("n_rows")
    )
    return g.where(F.col("__lo") == F.col("__hi")).select(key, F.col("__lo").alias(label), "n_rows")


def label_conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    g = df.where(F.col(label).isNotNull()).groupBy(key).agg(
        F.min(label).alias("__lo"), F.max(label).alias("__hi"), F.count(F.lit(1)).alias("n_rows")
    )
    return g.where(F.col("__lo") < F.col("__hi")).select(key, "n_rows")


def aggregate_replicates(df: DataFrame, keys, *, value="value_scaled", model="p_value", tolerance: float = 0.5) -> DataFrame:
    """Censor-aware replicate value: exact median if any exact row, else max of ``>``, min of ``<``,
    median under ``~`` when relations are mixed; with conflict flags."""
    keys = list(keys)
    src = df.where(F.col(value).isNotNull())
    rel = src.groupBy(*keys).agg(
        F.bool_or(F.col("relation") == "=").alias("__exact"),
        F.min("relation").alias("__rlo"),
        F.max("relation").alias("__rhi"),
        F.count(F.lit(1)).alias("replicate_count"),
        F.min(value).alias("value_min"),
        F.max(value).alias("value_max"),
        F.max(model).alias("__mhi"),
        F.min(model).alias("__mlo"),
    )
    rel = rel.withColumn(
        "relation_out",
        F.when(F.col("__exact"), "=").when(F.col("__rlo") == F.col("__rhi"), F.col("__rlo")).otherwise("~"),
    )
    picked = null_safe_join(src, rel.select(*keys, "__exact"), keys).where(
        ~F.col("__exact") | (F.col("relation") == "=")
    )
    med = group_quantiles(picked, value, {"__med": 0.5}, keys)
    out = null_safe_join(rel, med, keys)
    r = F.col("relation_out")
    return out.select(
        *keys,
        r.alias("relation"),
        F.when(r.isin(">", ">="), F.col("value_max"))
        .when(r.isin("<", "<="), F.col("value_min"))
        .otherwise(F.col("__med"))
        .alias("value"),
        "value_min",
        "value_max",
        "replicate_count",
        (F.col("__rlo") != F.col("__rhi")).alias("mixed_censoring"),
        (
            (F.col("replicate_count") > 1)
            & ((F.col("__rlo") != F.col("__rhi")) | ((F.col("__mhi") - F.col("__mlo")) > tolerance))
        ).alias("label_conflict"),
    )


def interval_consensus(df: DataFrame, keys, *, lower="p_lower_bound", upper="p_upper_bound", max_spread: float = 0.3) -> DataFrame:
    """Intersect repeated intervals per key; disagreement is quarantined with a reason.

    Intervals equal after rounding to six places count once.  Exact records win when the censored
    ones allow their median and their spread is small.
    """
    keys = list(keys)
    u = df.select(*keys, F.round(lower, 6).alias("lo"), F.round(upper, 6).alias("hi"))
    raw_n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    u = u.where(F.col("lo").isNotNull() | F.col("hi").isNotNull()).distinct()
    ex = F.col("lo") == F.col("hi")
    ex = F.coalesce(ex, F.lit(False))
    g = u.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_intervals"),
        F.count_if(ex).alias("n_exact"),
        (F.max(F.when(ex, F.col("lo"))) - F.min(F.when(ex, F.col("lo")))).alias("exact_spread"),
        F.max(F.when(~ex, F.col("lo"))).alias("cens_lo"),
        F.min(F.when(~ex, F.col("hi"))).alias("cens_hi"),
    )
    med = group_quantiles(u.where(ex), "lo", {"med": 0.5}, keys)
    out = null_safe_join(null_safe_join(g, med, keys, "left"), raw_n, keys)
    has = F.col("n_exact") > 0
    clash = (F.col("med") < F.col("cens_lo") - 1e-8) | (F.col("med") > F.col("cens_hi") + 1e-8)
    reason = (
        F.when(has & F.coalesce(clash, F.lit(False)), "exact_conflicts_with_censored")
        .when(has & (F.col("exact_spread") > max_spread), "exact_spread_too_wide")
        .when(~has & F.coalesce(F.col("cens_lo") > F.col("cens_hi"), F.lit(False)), "empty_intersection")
        .otherwise("")
    )
    ok = reason == ""
    return out.select(
        *keys,
        "n_rows",
        "n_intervals",
        "n_exact",
        "exact_spread",
        reason.alias("reason"),
        F.when(ok, F.when(has, F.col("med")).otherwise(F.col("cens_lo"))).alias("lower"),
        F.when(ok, F.when(has, F.col("med")).otherwise(F.col("cens_hi"))).alias("upper"),
    )


def geometric_collapse(df: DataFrame, key: str, value: str, signature) -> DataFrame:
    """Mean log10 per key over distinct source signatures (a repeated citation counts once)."""
    once = df.where(F.col(value) > 0).dropDuplicates([key, *signature])
    return once.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_signatures"), F.avg(F.log10(value)).alias("mean_log10")
    )


def balanced_rows(df: DataFrame, key: str, values) -> DataFrame:
    """One row per key: mean and population variance of each value column."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.var_pop(v).alias(f"{v}_var")]
    return df.groupBy(key).agg(*aggs)


def pick_preferred(df: DataFrame, keys, choice: str, priority) -> DataFrame:
    """Keep, per key, the rows whose ``choice`` comes first in the priority list."""
    rank = F.coalesce(lookup(F.col(choice), {p: i for i, p in enumerate(priority)}), F.lit(len(priority)))
    best = df.groupBy(*keys).agg(F.min(rank).alias("__best"))
    return null_safe_join(df, best, list(keys)).where(rank == F.col("__best")).drop("__best")


def simpson_support(df: DataFrame, keys, member: str) -> DataFrame:
    """Effective member count 1/sum(p^2), largest member size and singletons per key."""
    keys = list(keys)
    n = df.groupBy(*keys, member).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_members"),
        (F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("effective_members"),
        F.max("n").alias("largest_member"),
        F.count_if(F.col("n") == 1).alias("singleton_members"),
    )


def completeness(df: DataFrame, stratum, fields) -> DataFrame:
    """Fraction of non-blank values per stratum and field, in one pass."""
    g = df.groupBy(*stratum).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count(blank_to_null(f)).alias(f"__{f}") for f in fields]
    )
    cells = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__{f}").alias("n_present")) for f in fields])
    )
    return g.select(*stratum, "n_rows", cells.alias("c")).select(
        *stratum, "n_rows", "c.field", "c.n_present", (F.col("c.n_present") / F.col("n_rows")).alias("fraction")
    )


def signature_echo(df: DataFrame, group: str, signature) -> DataFrame:
    """How many rows repeat an identical signature, per group."""
    s = df.groupBy(group, F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in signature]), 256).alias("sig"))
    s = s.agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy(group).agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_signatures"),
        F.count_if(F.col("n") > 1).alias("n_repeated_signatures"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_rows_in_repeats"),
        F.max("n").alias("largest_repeat"),
    )


def exclusion_summary(df: DataFrame, subject: str = "subject_id", reason: str = "exclusion_reason") -> DataFrame:
    """Rows and distinct subjects per exploded exclusion reason; clean rows count as 'eligible'."""
    r = df.select(
        subject, F.explode(F.split(F.when(F.col(reason) == "", "eligible").otherwise(F.col(reason)), ";")).alias("reason")
    )
    per = r.groupBy("reason", subject).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("reason").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_subjects"))


def source_summary(df: DataFrame, source: str = "source", subject: str = "subject_id") -> DataFrame:
    per = df.groupBy(source, subject).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_eligible")).alias("e")
    )
    return per.groupBy(source).agg(
        F.sum("n").alias("n_measurements"),
        F.count(F.lit(1)).alias("n_subjects"),
        F.sum("e").alias("n_eligible"),
    )
