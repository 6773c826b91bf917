"""Normalisation of long measurement tables, eligibility gates, quarantine and mirror links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions import values as V
from proofmill.functions.text import clean, join_flags, stable_id
from proofmill.operators.ranking import null_safe_join
from proofmill.session import cut_lineage


def normalize_values(df: DataFrame, *, endpoint_names: dict | None = None, unit_table=None) -> DataFrame:
    """Parse value_text/relation/unit/endpoint into typed columns with censoring bounds.

    Expects ``value_text``, ``relation``, ``unit``, ``endpoint``; originals are kept with an
    ``_original`` suffix.  A missing or unknown unit gives NULL scaled values, never a default.
    """
    table = unit_table or V.CONCENTRATION_TO_NANO
    # staged so every regular expression runs once per row and later stages only read columns
    spelled = {**V.RELATION_SPELLINGS, "": "="}
    endpoint = clean("endpoint")
    if endpoint_names:
        plain = lambda x: F.upper(F.translate(x, V.BLANKS + "_-", ""))
        endpoint = V.once(endpoint, lambda x: F.coalesce(V.lookup(plain(x), endpoint_names), x))
    out = df.withColumns(
        {
            "endpoint_original": F.col("endpoint"),
            "relation_original": F.col("relation"),
            "unit_original": F.col("unit"),
            "endpoint": endpoint,
            "relation": V.once(V.relation_text("value_text", "relation"), lambda x: F.coalesce(V.lookup(x, spelled), x)),
            "unit_normalized": V.normalize_unit("unit"),
            "value_numeric": V.parse_numeric("value_text"),
        }
    )
    u = F.col("unit_normalized")
    out = out.withColumn("__factor", V.lookup(u, table))
    status = F.when(u == "", "missing_unit").when(F.col("__factor").isNotNull(), "converted").otherwise("unsupported_unit")
    out = out.withColumns({"unit_status": status, "__scaled": F.col("value_numeric") * F.col("__factor")})
    out = out.withColumn("value_scaled", F.when(F.col("__scaled") > 0, F.col("__scaled")))
    out = out.withColumn("p_value", V.p_value("value_scaled")).drop("__factor", "__scaled")
    lower, upper = V.bounds("value_scaled", "relation")
    p_low_src, p_up_src = V.bounds("p_value", "relation")
    return out.withColumns(
        {
            "is_exact": F.col("relation") == "=",
            "is_censored": F.col("relation").isin("<", "<=", ">", ">="),
            "censoring": V.censoring_direction("relation"),
            "lower_bound": lower,
            "upper_bound": upper,
            # the p-scale inverts: an upper concentration bound is a lower p bound
            "p_lower_bound": p_up_src,
            "p_upper_bound": p_low_src,
            "value_semantics": F.when(F.col("relation") == "=", "point_estimate")
            .when(F.col("relation") == "~", "approximate_point")
            .when(F.col("relation").isin("<", "<=", ">", ">="), "censoring_threshold")
            .otherwise("invalid"),
        }
    )


IDENTITY = (
    "source",
    "record_id",
    "subject_id",
    "assay_id",
    "endpoint",
    "relation",
    "value_numeric",
    "unit_normalized",
    "document_id",
)


def measurement_ids(df: DataFrame, fields=IDENTITY) -> DataFrame:
    return df.withColumn("measurement_id", stable_id("MEA", fields, 24))


def repeated_identities(df: DataFrame, fields, record: str, order: str) -> DataFrame:
    """First ``order`` value of every identity that occurs more than once."""
    g = df.where(clean(record) != "").groupBy(*fields)
    g = g.agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n"))
    return g.where(F.col("__n") > 1).drop("__n")


def flag_duplicates(df: DataFrame, *, fields=IDENTITY, record: str = "record_id", order: str = "row_key", repeated=None) -> DataFrame:
    """True for every row but the first (by the unique ``order`` column) of an identity group.

    Only identities that occur twice are joined back: normally a small table, which adaptive execution
    broadcasts after measuring it; a huge one stays a splittable shuffle join.  No window, so a
    repeated identity never lands whole in one task.
    """
    firsts = repeated_identities(df, fields, record, order) if repeated is None else repeated
    out = null_safe_join(df, firsts, list(fields), "left")
    later = F.coalesce(F.col(order) != F.col("__first"), F.lit(False))
    return out.withColumn("is_duplicate", (clean(record) != "") & later).drop("__first")


def conflicting_records(df: DataFrame, keys, compare, record: str) -> DataFrame:
    """Record keys with more than one distinct value, found from minimum and maximum."""
    spread = df.where(clean(record) != "").groupBy(*keys).agg(
        *[F.min(c).alias(f"__lo_{c}") for c in compare], *[F.max(c).alias(f"__hi_{c}") for c in compare]
    )
    bad = F.lit(False)
    for c in compare:
        bad = bad | F.coalesce(F.col(f"__lo_{c}") < F.col(f"__hi_{c}"), F.lit(False))
    return spread.where(bad).select(*keys, F.lit(True).alias("__bad"))


RECORD = ("source", "record_id", "endpoint")
COMPARED = ("value_numeric", "subject_id")


def flag_record_conflicts(df: DataFrame, *, keys=RECORD, compare=COMPARED, record="record_id", conflicts=None) -> DataFrame:
    """True when one record key carries more than one non-NULL value in any compared column."""
    bad = conflicting_records(df, keys, compare, record) if conflicts is None else conflicts
    out = null_safe_join(df, bad, list(keys), "left")
    return out.withColumn("record_conflict", (clean(record) != "") & F.col("__bad").isNotNull()).drop("__bad")


def gate(
    df: DataFrame,
    *,
    core_endpoints,
    extra_rules: tuple[tuple[Column, str | None, str | None], ...] = (),
    reported_p: str | None = None,
    tolerance: float = 0.05,
    carried: str | None = None,
) -> DataFrame:
    """Attach flags, exclusion reasons and eligibility; nothing is dropped.

    ``extra_rules`` holds (condition, flag, reason) as the rule functions below make them; a reason excludes, a
    flag without one only asks for review.  ``carried`` names a column of earlier flags, joined by semicolons.
    """
    # parsed once and stored; a duplicate or a conflict needs a record that occurs twice, so only rows whose
    # hashed record does are looked at more closely
    hashed = F.xxhash64(*[clean(c) for c in RECORD])
    base = cut_lineage(df.withColumn("__hash", hashed))
    again = base.where(clean("record_id") != "").groupBy("__hash").agg(F.count(F.lit(1)).alias("__n"))
    again = cut_lineage(again.where("__n > 1").select("__hash"))
    some = cut_lineage(measurement_ids(base.join(again, "__hash", "left_semi").drop("__hash")))
    firsts = repeated_identities(some, ("measurement_id",), "record_id", "row_key")
    conflicts = conflicting_records(some, RECORD, COMPARED, "record_id")
    some = flag_duplicates(some, fields=("measurement_id",), repeated=firsts)
    some = flag_record_conflicts(some, conflicts=conflicts)
    rest = measurement_ids(base.join(again, "__hash", "left_anti").drop("__hash"))
    out = rest.withColumns({"is_duplicate": F.lit(False), "record_conflict": F.lit(False)}).unionByName(some)
    rules: list[tuple[Column, Column, bool]] = [
        (clean("subject_id") == "", F.lit("missing_subject"), True),
        (F.col("value_numeric").isNull(), F.lit("missing_or_non_numeric_value"), True),
        (F.col("value_numeric") <= 0, F.lit("nonpositive_value"), True),
        (F.col("unit_status") != "converted", F.col("unit_status"), True),
        (~F.col("endpoint").isin(*core_endpoints), F.lit("unsupported_endpoint"), True),
        (~F.col("relation").isin(*V.RELATIONS), F.lit("invalid_relation"), True),
        (F.col("is_duplicate"), F.lit("duplicate_measurement"), True),
        (F.col("record_conflict"), F.lit("source_record_conflict"), True),
        (F.col("relation") == "~", F.lit("approximate_value"), False),
    ]
    if reported_p:
        delta = F.abs(F.col(reported_p) - F.col("p_value"))
        rules.append((delta > tolerance, F.lit("conversion_mismatch"), True))
    flags = [F.when(c, f) for c, f, _ in rules] + [F.when(c, f if isinstance(f, Column) else F.lit(f)) for c, f, _ in extra_rules if f is not None]
    reasons = [F.when(c, f) for c, f, x in rules if x] + [F.when(c, F.lit(r)) for c, _, r in extra_rules if r is not None]
    all_flags = F.array(*flags)
    if carried:
        all_flags = F.concat(all_flags, F.filter(F.split(F.coalesce(F.col(carried), F.lit("")), ";"), lambda x: x != ""))
    return out.withColumns(
        {
            "quality_flags": join_flags(all_flags),
            "exclusion_reason": join_flags(F.array(*reasons)),
            "is_core_endpoint": F.col("endpoint").isin(*core_endpoints),
        }
    ).withColumns(
        {
            "is_eligible": F.col("exclusion_reason") == "",
            "requires_review": F.col("quality_flags") != "",
        }
    )


def structure_rules(original: str, status: str, *, invalid, unchecked):
    """Rules for the subject's own description: missing, of an invalid status (flagged as it is), or never checked."""
    gone = clean(original) == ""
    bad = ~gone & clean(status).isin(*invalid)
    return (
        (gone, "missing_structure", "missing_structure"),
        (bad, clean(status), "invalid_structure"),
        (~gone & ~bad & clean(status).isin(*unchecked), "structure_not_validated", None),
    )


def target_rules(relevant: str, relevance: str, *, excluded):
    """Rules for rows whose target does not count: decided against, or undecided."""
    off = ~F.coalesce(F.col(relevant), F.lit(False))
    against = clean(relevance).isin(*excluded)
    return ((off & against, "target_not_relevant", "target_not_relevant"), (off & ~against, "target_relevance_unresolved", "target_relevance_unresolved"))


def curated_source_rules(source: str, name: str, *, standard: str, comment: str, accepted, duplicate: str | None = None):
    """Rules for a source that marks its own records: not of standard form, a comment on validity, a possible duplicate."""
    own = F.lower(clean(source)) == name
    number = lambda c: F.col(c).cast("double")
    rules = [
        (own & ~F.coalesce(number(standard) == 1, F.lit(False)), f"{name}_nonstandard_measurement"),
        (own & ~F.lower(clean(comment)).isin(*accepted), f"{name}_data_validity_warning"),
    ]
    if duplicate:
        rules.append((own & F.coalesce(number(duplicate) == 1, F.lit(False)), f"{name}_potential_duplicate"))
    return tuple((c, f, f) for c, f in rules)


def variant_rules(variant: str):
    """Rows measured on a variant of the target are left out."""
    return ((clean(variant) != "", "variant_excluded", "variant_excluded"),)


def quarantine(df: DataFrame, eligible: str = "is_eligible") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) views of one gated table."""
    ok = F.coalesce(F.col(eligible), F.lit(False))
    return df.where(ok), df.where(~ok)


def link_mirrors(
    df: DataFrame,
    *,
    priority,
    keys=("subject_id", "endpoint", "family", "relation", "p_value"),
    source: str = "source",
    eligible: str = "is_eligible",
) -> DataFrame:
    """Link observations repeated across sources; same-source replicates are never collapsed.

    Only eligible rows count: a quarantined preferred record suppresses nothing.  State per group
    is two minima, one maximum and the distinct sources; sources that share the best rank (all
    unlisted ones rank last) are named together.
    """
    rank = F.coalesce(
        V.lookup(F.lower(clean(source)), {s: i for i, s in enumerate(priority)}), F.lit(99)
    )
    work = df.withColumn("__prio", rank)
    ok = F.coalesce(F.col(eligible), F.lit(False))
    group = work.where(ok & F.col("p_value").isNotNull()).groupBy(*keys).agg(
        F.min(source).alias("__lo"),
        F.max(source).alias("__hi"),
        F.min("__prio").alias("__best"),
        F.collect_set(F.struct(F.col("__prio").alias("p"), F.col(source).alias("s"))).alias("__seen"),
    )
    best = F.filter("__seen", lambda x: x["p"] == F.col("__best"))
    pref = F.concat_ws(";", F.array_sort(F.transform(best, lambda x: x["s"])))
    group = group.where(F.col("__lo") < F.col("__hi")).withColumn("__pref", pref).drop("__lo", "__hi", "__seen")
    out = null_safe_join(work, group, list(keys), "left")
    cand = ok & F.col("__best").isNotNull() & F.col("p_value").isNotNull()
    return out.withColumns(
        {
            "is_mirror_candidate": cand,
            "is_mirror_redundant": cand & (F.col("__prio") > F.col("__best")),
            "mirror_group_id": F.when(cand, stable_id("MIR", keys, 20)).otherwise(""),
            "mirror_preferred_source": F.when(cand, F.col("__pref")).otherwise(""),
        }
    ).drop("__prio", "__best", "__pref")


def apply_censoring_policy(df: DataFrame, policy: str, keys) -> DataFrame:
    """strict_exact | prefer_exact_per_subject | include_all, decided per key group."""
    if policy == "include_all":
        return df
    exact = df.where(F.col("is_exact"))
    if policy == "strict_exact":
        return exact
    if policy != "prefer_exact_per_subject":
        raise ValueError(f"unknown censoring policy {policy!r}")
    have = exact.select(*keys).distinct().withColumn("__has", F.lit(True))
    out = null_safe_join(df, have, list(keys), "left")
    return out.where(F.col("is_exact") | F.col("__has").isNull()).drop("__has")
