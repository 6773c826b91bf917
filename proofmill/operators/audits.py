"""Audit rules over measurement tables: one findings table, one row per (row, code, column)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions.text import blank_to_null, clean, optional_bool
from proofmill.functions.values import CONCENTRATION_TO_NANO, RELATIONS, normalize_unit, p_value, parse_numeric, unit_factor
from proofmill.operators.ranking import null_safe_join
from proofmill.session import cut_lineage


@dataclass
class AuditPolicy:
    required: tuple = ("source", "record_id", "subject_id", "endpoint")
    columns: tuple = ("source", "record_id", "subject_id", "endpoint", "relation", "value_text", "unit")
    concentration_endpoints: tuple = ()
    mass_endpoints: tuple = ()
    unitless_endpoints: tuple = ()
    mass_units: tuple = ("mg/ml", "ug/ml", "ng/ml", "g/l", "mg/l")
    extra_units: tuple = ("%", "mg/ml", "ug/ml", "ng/ml", "g/l", "mg/l")
    p_range: tuple = (0.0, 14.0)
    year_range: tuple = (1900, 2100)
    expected_target_ids: tuple = ()
    expected_target_terms: tuple = ()
    ambiguous_terms: tuple = ("unspecified", "unknown", "not specified")
    identity: tuple = ("record_id", "subject_id")
    compare: tuple = ("subject_id", "endpoint", "value_text", "unit", "target_id")
    repeat_log10: float = 1.0
    units: dict = field(default_factory=lambda: CONCENTRATION_TO_NANO)


def table_findings(df: DataFrame, policy: AuditPolicy) -> list[tuple]:
    """Table-level findings: absent required columns."""
    return [("missing_required_column", "error", c) for c in policy.columns if c not in df.columns]


def _varies(df: DataFrame, keys, columns, out: str) -> DataFrame:
    """Per key: does any listed column hold more than one non-blank value?  Constant state per key."""
    g = df.groupBy(*keys).agg(
        *[F.min(blank_to_null(c)).alias(f"__lo_{c}") for c in columns], *[F.max(blank_to_null(c)).alias(f"__hi_{c}") for c in columns]
    )
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.col(f"__lo_{c}") < F.col(f"__hi_{c}"), F.lit(False))
    return g.select(*keys, bad.alias(out))


def _base(df: DataFrame, policy: AuditPolicy, key: str) -> DataFrame:
    """The stored columns that rules and grouped facts read."""
    d = df.withColumns(
        {
            "__source": clean("source"),
            "__record": clean("record_id"),
            "__value": parse_numeric("value_text"),
            "__unit": normalize_unit("unit"),
            "__desc": F.regexp_replace(F.lower(clean("description")), r"\s+", " "),
        }
    )
    d = d.withColumn("__scaled", F.col("__value") * unit_factor("unit", policy.units))
    content = F.sha2(F.concat_ws("\0", *[clean(c) for c in df.columns if c != "row_key"]), 256)
    # the tests of one row and the grouped facts are read from this table, so it is stored once
    return cut_lineage(d.withColumn("__content", F.substring(F.unhex(content), 1, 16)).withColumn("__usable", clean("relation").isin("", "=") & (F.col("__scaled") > 0)))


def grouped_findings(base: DataFrame, policy: AuditPolicy, key: str) -> DataFrame:
    """Findings that depend on other rows.  Each is a few columns joined with the groups that break its rule; whole rows never move."""
    row = lambda code, severity, column: (F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(column).alias("column"))
    names = ["__source", "__record"]
    named = base.where(F.col("__record") != "")
    ids = named.groupBy(*names).agg(F.count(F.lit(1)).alias("__id_n")).where("__id_n > 1").select(*names)
    # rows of one content share their identifier, and only identifiers that occur twice can conflict
    twice = cut_lineage(named.select(key, *names, "__content", *policy.compare).join(ids, names))
    same = twice.groupBy("__content").agg(F.count(F.lit(1)).alias("__same_n")).where("__same_n > 1").select("__content")
    id_bad = _varies(twice, names, policy.compare, "__id_bad").where("__id_bad").select(*names)
    a, b = policy.identity
    ident = _varies(base, [a], [b], "__bad").where("__bad").select(a)
    desc = _varies(base, ["__desc"], ["method", "target_id"], "__bad").where("__bad").select("__desc")
    keys = ["subject_id", "endpoint", "target_id"]
    usable = base.where("__usable")
    spread = F.log10(F.max("__scaled")) - F.log10(F.min("__scaled"))
    rep = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rep_n"), spread.alias("__rep_spread"))
    rep = rep.where((F.col("__rep_n") > 1) & (F.col("__rep_spread") >= policy.repeat_log10)).select(*keys)
    found = [
        twice.select(key, *row("duplicate_identifier", "warning", "record_id")),
        twice.select(key, "__content").join(same, "__content").select(key, *row("exact_duplicate_row", "warning", "record_id")),
        twice.select(key, *names).join(id_bad, names).select(key, *row("conflicting_identifier", "error", "record_id")),
        null_safe_join(base.select(key, a), ident, [a]).select(key, *row("identity_conflict", "error", a)),
        base.select(key, "__desc").where(F.col("__desc") != "").join(desc, "__desc").select(key, *row("assay_metadata_conflict", "warning", "description")),
        null_safe_join(usable.select(key, *keys), rep, keys).select(key, *row("conflicting_repeated_measurement", "warning", "value_text")),
    ]
    out = found[0]
    for d in found[1:]:
        out = out.unionByName(d)
    return out


def findings(df: DataFrame, policy: AuditPolicy, key: str = "row_key") -> DataFrame:
    """(key, code, severity, column, value) for every violated rule."""
    d = _base(df, policy, key)
    conc = F.col("endpoint").isin(*policy.concentration_endpoints)
    known = [*policy.units, *policy.extra_units]
    missing_unit = F.col("__unit") == ""
    mass_ok = F.col("endpoint").isin(*policy.mass_endpoints) & F.col("__unit").isin(*policy.mass_units)
    value_blank = clean("value_text") == ""
    p = p_value("__scaled")
    year = F.col("yr")
    tid, tname = clean("target_id"), clean("target_name")
    relevant = F.coalesce(optional_bool("is_target_relevant"), F.lit(False))
    id_hit = F.arrays_overlap(F.transform(F.split(F.lower(tid), "[,;|]"), lambda x: F.trim(x)), F.array(*map(F.lit, policy.expected_target_ids)))
    name_hit = F.lower(tname).rlike("|".join(policy.expected_target_terms) or "$^")
    desc, method = F.col("__desc"), clean("method")
    sev = lambda c, a, b: F.when(c, a).otherwise(b)
    rules: list[tuple[Column, str, object, str]] = [
        *[(clean(c) == "", "missing_required_value", "error", c) for c in policy.required],
        (~value_blank & F.col("__value").isNull(), "invalid_numeric_value", "error", "value_text"),
        (value_blank, "missing_numeric_value", "error", "value_text"),
        (conc & (F.col("__value") <= 0), "nonpositive_value", "error", "value_text"),
        (~p.between(*policy.p_range), "value_out_of_range", "warning", "p_value"),
        (~year.between(*policy.year_range), "value_out_of_range", "warning", "yr"),
        (missing_unit & ~F.col("endpoint").isin(*policy.unitless_endpoints), "missing_unit", sev(conc, "error", "warning"), "unit"),
        (~missing_unit & ~F.col("__unit").isin(*known), "unknown_unit", sev(conc, "error", "warning"), "unit"),
        (conc & ~missing_unit & ~F.col("__unit").isin(*policy.units) & ~mass_ok, "incompatible_unit", "error", "unit"),
        (mass_ok, "mass_unit_needs_weight", "info", "unit"),
        (~clean("relation").isin(*RELATIONS), "unknown_relation", "warning", "relation"),
        ((tid == "") & (tname == "") & ~relevant, "missing_target", "error", "target_id"),
        ((tid == "") & (tname == "") & relevant, "target_identity_derived", "warning", "target_id"),
        ((tid == "") != (tname == ""), "incomplete_target_identity", "warning", "target_id"),
        (F.lower(tid).rlike(r"[,;|]|\bunknown\b"), "ambiguous_target", "warning", "target_id"),
        (((tid != "") | (tname != "")) & ~relevant & ~id_hit & ~name_hit, "unexpected_target", "error", "target_id"),
        (desc == "", "missing_description", "warning", "description"),
        (method == "", "missing_method", "warning", "method"),
        ((desc == "") & (method == ""), "assay_ambiguity", "warning", "description"),
        (desc.rlike("|".join(policy.ambiguous_terms)), "ambiguous_context", "warning", "description"),
    ]
    items = []
    for cond, code, severity, column in rules:
        s = severity if isinstance(severity, Column) else F.lit(severity)
        items.append(F.when(cond, F.struct(F.lit(code).alias("code"), s.alias("severity"), F.lit(column).alias("column"))))
    alone = d.select(key, F.explode(F.array_compact(F.array(*items))).alias("x")).select(key, "x.*")
    return alone.unionByName(grouped_findings(d, policy, key))


def summarize(found: DataFrame, key: str = "row_key") -> DataFrame:
    return found.groupBy("severity", "code", "column").agg(F.count(F.lit(1)).alias("n_findings"))


def issue_dedupe(df: DataFrame, payload: str, path: str, fields, subject: str) -> DataFrame:
    """Raw against unique issue rows, and affected subjects, per issue field set with a JSON detail."""
    d = df.withColumn("__detail", F.get_json_object(payload, path))
    per = d.groupBy(*fields, subject, "__detail").agg(F.count(F.lit(1)).alias("n"))
    sub = per.groupBy(*fields, subject).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("u"))
    return sub.groupBy(*fields).agg(
        F.sum("n").alias("n_raw"), F.sum("u").alias("n_unique"), F.count(F.lit(1)).alias("n_subjects")
    )


class LeakageError(ValueError):
    pass


def require_roles(df: DataFrame, role: str, allowed) -> DataFrame:
    """Fail when any row carries a role outside the allowed ones; stops at the first such row."""
    bad = df.where(~F.coalesce(F.col(role).isin(*allowed), F.lit(False))).select(role).limit(1).collect()
    if bad:
        raise LeakageError(f"role {bad[0][role]!r} is not allowed here")
    return df


def resolve_roles(df: DataFrame, role: str | None, fold: str, holdout_fold: int) -> DataFrame:
    """Explicit role when given, otherwise from the fold."""
    derived = F.when(F.col(fold) == holdout_fold, "validation").otherwise("train")
    return df.withColumn("resolved_role", F.coalesce(blank_to_null(role), derived) if role else derived)


def lineage_check(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """match / mismatch / missing / extra per metadata key."""
    e = expected.select(key, F.col(value).alias("expected"))
    a = actual.select(key, F.col(value).alias("actual"))
    j = e.withColumn("__e", F.lit(1)).join(a.withColumn("__a", F.lit(1)), key, "full_outer")
    status = (
        F.when(F.col("__a").isNull(), "missing")
        .when(F.col("__e").isNull(), "extra")
        .when(F.col("expected").eqNullSafe(F.col("actual")), "match")
        .otherwise("mismatch")
    )
    return j.select(key, "expected", "actual", status.alias("status"))
