"""Queries over the measurement view: parsing, gates, mirrors and subject aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill.functions import text as T
from proofmill.functions import values as V
from proofmill.functions.classify import Rule, any_listed, classify, classify_struct, first_pattern, first_term, first_verdict
from proofmill.operators import aggregate as A
from proofmill.operators import gates as G
from proofmill.plans.bindings import CORE_ENDPOINTS
from proofmill.plans.registry import VIEWS, query
from proofmill.session import cut_lineage


def rnd(*cols, digits=6):
    return [F.round(c, digits).alias(c) for c in cols]


VIEWS["gated"] = """
select *, case when not elig_txt then reason else '' end as exclusion_reason, elig_txt as is_eligible from (
 select *, reason='' as elig_txt from (
 select *, endpoint in ('urgent','high','medium','low') as is_core_endpoint, relation='=' as is_exact,
  relation in ('<','<=','>','>=') as is_censored,
  array_to_string(list_sort(list_distinct(list_filter([
   case when value_numeric is null then 'missing_or_non_numeric_value' end,
   case when value_numeric<=0 then 'nonpositive_value' end,
   case when unit_status<>'converted' then unit_status end,
   case when endpoint not in ('urgent','high','medium','low') then 'unsupported_endpoint' end,
   case when is_duplicate then 'duplicate_measurement' end,
   case when record_conflict then 'source_record_conflict' end], lambda x: x is not null))),';') as reason
 from (select *,
   row_number() over (partition by source,record_id,subject_id,assay_id,endpoint,relation,value_numeric,unit_normalized,document_id order by row_key)>1 as is_duplicate,
   coalesce(min(value_numeric) over r < max(value_numeric) over r, false) or coalesce(min(subject_id) over r < max(subject_id) over r, false) as record_conflict
  from @normalized window r as (partition by source,record_id,endpoint))))
"""
VIEWS["mirrored"] = """
select *, cand as is_mirror_candidate, cand and prio>best as is_mirror_redundant,
 case when cand then case best when 0 then 'alpha' when 1 then 'beta' else 'gamma' end else '' end as mirror_preferred_source
from (select *, is_eligible and p_value is not null and lo<hi as cand from (
 select *, min(case when is_eligible then prio end) over g as best,
  min(case when is_eligible then source end) over g as lo, max(case when is_eligible then source end) over g as hi
 from (select *, case source when 'alpha' then 0 when 'beta' then 1 else 2 end as prio from @gated)
 window g as (partition by subject_id, endpoint, family, relation, p_value)))
"""


@query("relation_extract", """
select relation, count(*) as n, sum(case when value_text like '>%' then 1 else 0 end)::bigint as n_prefixed from @normalized group by relation
""")
def relation_extract(t):
    d = t.raw.select("value_text", V.extract_relation("value_text", "relation").alias("relation"))
    return d.groupBy("relation").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value_text").startswith(">")).alias("n_prefixed")
    )


@query("numeric_parse", """
select value_text, min(value_numeric) as value, count(*) as n from @normalized group by value_text
""")
def numeric_parse(t):
    d = t.raw.select("value_text", V.parse_numeric("value_text").alias("value"))
    return d.groupBy("value_text").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("n"))


@query("qualified_value_parse", """
select value_text, count(*) as n,
 case when status='parsed' then try_cast(regexp_extract(rest,'^([+-]?[0-9.]+)',1) as double) end as value,
 case when status='missing' then 'not_reported' when status='interval' then '~' else rel end as relation,
 case when status='missing' then 'missing' when status='interval' then 'interval' when rel in ('<','<=') then 'left' when rel in ('>','>=') then 'right' else 'none' end as censoring,
 case when status='interval' then least(split_part(rest,'-',1)::double, split_part(rest,'-',2)::double) end as lower_bound,
 case when status='interval' then greatest(split_part(rest,'-',1)::double, split_part(rest,'-',2)::double) end as upper_bound,
 case when status='parsed' and rest like '% nM' then 'nM' end as annotation, status
from (select value_text, case when value_text like '>%' then '>' else '=' end as rel,
  replace(replace(value_text,'>',''),',','') as rest,
  case when value_text='not reported' then 'missing' when regexp_matches(value_text,'^[0-9]+-[0-9]+$') then 'interval' else 'parsed' end as status from @raw)
group by value_text, rel, rest, status
""")
def qualified_value_parse(t):
    d = t.raw.groupBy("value_text").agg(F.count(F.lit(1)).alias("n"))
    return V.with_qualified(d, "value_text", "q").select("value_text", "n", "q.*")


@query("unit_conversion", """
select unit, unit_normalized, unit_status, round(min(factor),6) as factor, count(*) as n from @normalized group by 1,2,3
""")
def unit_conversion(t):
    d = t.raw.select(
        "unit",
        V.normalize_unit("unit").alias("unit_normalized"),
        V.unit_status("unit").alias("unit_status"),
        V.unit_factor("unit").alias("factor"),
    )
    return d.groupBy("unit", "unit_normalized", "unit_status").agg(
        F.round(F.min("factor"), 6).alias("factor"), F.count(F.lit(1)).alias("n")
    )


@query("p_scale_bounds", """
select row_key, relation, round(p_value,6) as p_value,
 round(case when relation in ('=','~','<','<=') then p_value end,6) as p_lower_bound,
 round(case when relation in ('=','~','>','>=') then p_value end,6) as p_upper_bound,
 case when relation in ('<','<=') then 'left' when relation in ('>','>=') then 'right' when relation='~' then 'approximate' else 'none' end as censoring
from @normalized
""")
def p_scale_bounds(t):
    return t.normalized.select(
        "row_key", "relation", *rnd("p_value", "p_lower_bound", "p_upper_bound"), "censoring"
    )


@query("model_scale", """
select row_key, transform, round(v,6) as value,
 round(case when transform='p' then case when relation in ('=','~','<','<=') then v end else case when relation in ('=','~','>','>=') then v end end,6) as lower,
 round(case when transform='p' then case when relation in ('=','~','>','>=') then v end else case when relation in ('=','~','<','<=') then v end end,6) as upper
from (select *, case when transform='identity' then value_numeric when value_numeric<=0 then null when transform='log10' then log10(value_numeric)
   else -log10(value_numeric*1e-9) end as v
 from (select *, case family when 'F' then 'identity' when 'O' then 'log10' else 'p' end as transform from @normalized))
""")
def model_scale(t):
    tr = F.when(F.col("family") == "F", "identity").when(F.col("family") == "O", "log10").otherwise("p")
    d = t.normalized.withColumn("transform", tr)
    s = V.model_scale("value_numeric", "relation", "transform", F.lit("nM"))
    return d.select("row_key", "transform", s.alias("s")).select(
        "row_key", "transform", *[F.round(f"s.{c}", 6).alias(c) for c in ("value", "lower", "upper")]
    )


@query("endpoint_normalize", """
select endpoint, case when endpoint in ('urgent','high') then 'fast' when endpoint in ('medium','low') then 'slow' else 'other' end as endpoint_family, count(*) as n
from @normalized group by 1,2
""")
def endpoint_normalize(t):
    fam = V.lookup(F.col("endpoint"), {"urgent": "fast", "high": "fast", "medium": "slow", "low": "slow"})
    d = t.normalized.select("endpoint", F.coalesce(fam, F.lit("other")).alias("endpoint_family"))
    return d.groupBy("endpoint", "endpoint_family").agg(F.count(F.lit(1)).alias("n"))


FAMILY_RULES = (
    Rule("electrical", pattern=r"brass|copper"),
    Rule("standard_line", codes=("STANDARD",)),
    Rule("promo_line", codes=("PROMO",)),
    Rule("coloured", pattern=r"\bred\b|\bblue\b|\bgreen\b"),
    Rule("economy_or_ring", codes=("ECONOMY",), kinds=("ring",), any_of=True),
)


@query("family_classify", """
select family, count(*) as n from (select case
 when regexp_matches(lower(p_name),'brass|copper') then 'electrical' when upper(p_type)='STANDARD' then 'standard_line' when upper(p_type)='PROMO' then 'promo_line'
 when regexp_matches(lower(p_name),'\\bred\\b|\\bblue\\b|\\bgreen\\b') then 'coloured'
 when upper(p_type)='ECONOMY' or split_part(p_name,' ',2)='ring' then 'economy_or_ring' else 'unclassified' end as family from part) group by family
""")
def family_classify(t):
    d = t.part.withColumn("noun", F.element_at(F.split("p_name", " "), 2))
    fam = classify(FAMILY_RULES, code="p_type", kind="noun", text="p_name")
    return d.select(fam.alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query("target_relevance", """
select status, relevant, reason, count(*) as n from (select case
 when p_size=1 then 'manual_include' when p_size=2 then 'manual_exclude' when p_size=3 then 'manual_review'
 when list_contains(string_split(lower(p_brand),'#'),'7') then 'confirmed_accession'
 when p_name like '%ring%' then 'confirmed_target_name' when p_type='ECONOMY' then 'off_target'
 when lower(p_type) like '%promo%' then 'text_supported' when lower(p_type) like '%standard%' then 'off_target' else 'unresolved' end as status from part) s
 join (values ('manual_include',true,'included by review'),('manual_exclude',false,'excluded by review'),('manual_review',false,'review required'),
 ('confirmed_accession',true,'target accession present'),('confirmed_target_name',true,'target name present'),('off_target',false,''),
 ('text_supported',true,'text names the target'),('unresolved',false,'no target evidence')) v(status2,relevant,reason) on status=status2 group by 1,2,3
""")
def target_relevance(t):
    d = t.part
    decision = F.when(F.col("p_size") == 1, "include").when(F.col("p_size") == 2, "rejected").when(F.col("p_size") == 3, "pending")
    name = F.when(F.col("p_name").contains("ring") | (F.col("p_type") == "ECONOMY"), F.col("p_name"))
    named, text = F.coalesce(F.lower(name), F.lit("")), F.lower("p_type")
    target = r"ring|promo"
    v = first_verdict(
        [
            (decision == "include", ("manual_include", True, "included by review")),
            (decision == "rejected", ("manual_exclude", False, "excluded by review")),
            (decision == "pending", ("manual_review", False, "review required")),
            (any_listed(F.replace("p_brand", F.lit("#"), F.lit(";")), ("7",)), ("confirmed_accession", True, "target accession present")),
            (named.rlike(target), ("confirmed_target_name", True, "target name present")),
            ((named != "") | (~text.rlike(target) & text.rlike("standard")), ("off_target", False, "")),
            (text.rlike(target), ("text_supported", True, "text names the target")),
            (None, ("unresolved", False, "no target evidence")),
        ],
        ("status", "relevant", "reason"),
    )
    d = d.select(v.alias("v")).select("v.*")
    return d.groupBy("status", "relevant", "reason").agg(F.count(F.lit(1)).alias("n"))


KIND_RULES = (
    (("promo",), r"\bring\b|\bwidget\b", ("fast_group", "ring_or_widget", "higher_is_better", "kind+text:promo")),
    (("promo",), "", ("fast_group", "other", "lower_is_better", "kind:promo")),
    (("economy", "standard"), r"\bred\b", ("colour_group", "red", "context_dependent", "kind+text:red")),
    ((), r"\bblue\b", ("colour_group", "blue", "context_dependent", "text:blue")),
)


@query("rule_table_classify", """
select category, endpoint, direction, rule, colour, route, count(*) as n from (
 select p_name, lower(p_type) as k, case when p_name like '%red%' then 'red' when p_name like '%blue%' then 'blue' when p_name like '%green%' then 'green' else '' end as colour,
  case when regexp_matches(p_name,'\\bsmall\\b|\\blarge\\b') then 'sized' when regexp_matches(p_name,'\\bring\\b') then 'round' else '' end as route from part)
 , lateral (select case when k='promo' and regexp_matches(p_name,'\\bring\\b|\\bwidget\\b') then 1 when k='promo' then 2
   when k in ('economy','standard') and regexp_matches(p_name,'\\bred\\b') then 3 when regexp_matches(p_name,'\\bblue\\b') then 4 else 5 end as r)
 join (values (1,'fast_group','ring_or_widget','higher_is_better','kind+text:promo'),(2,'fast_group','other','lower_is_better','kind:promo'),
  (3,'colour_group','red','context_dependent','kind+text:red'),(4,'colour_group','blue','context_dependent','text:blue'),(5,'','','','')) v(r2,category,endpoint,direction,rule) on r=r2
group by 1,2,3,4,5,6
""")
def rule_table_classify(t):
    s = classify_struct(KIND_RULES, ("category", "endpoint", "direction", "rule"), kind="p_type", text="p_name")
    d = t.part.select(
        s.alias("s"),
        first_term("p_name", ("red", "blue", "green")).alias("colour"),
        first_pattern("p_name", ((r"\bsmall\b|\blarge\b", "sized"), (r"\bring\b", "round"))).alias("route"),
    ).select("s.*", "colour", "route")
    return d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("n"))


@query("analysis_ready_subset", """
select distinct p_partkey, category, endpoint, value_numeric, p_size between 1 and 25 as is_ready,
 array_to_string(list_filter([case when p_size is null then 'missing_numeric' end, case when p_size>25 then 'missing_unit' end], lambda x: x is not null),';') as flags
from (select *, p_size::double as value_numeric, case when lower(p_type)='promo' then 'fast_group' when lower(p_type) in ('economy','standard') and regexp_matches(p_name,'\\bred\\b') then 'colour_group'
  when regexp_matches(p_name,'\\bblue\\b') then 'colour_group' else '' end as category,
  case when lower(p_type)='promo' and regexp_matches(p_name,'\\bring\\b|\\bwidget\\b') then 'ring_or_widget' when lower(p_type)='promo' then 'other'
  when lower(p_type) in ('economy','standard') and regexp_matches(p_name,'\\bred\\b') then 'red' when regexp_matches(p_name,'\\bblue\\b') then 'blue' else '' end as endpoint from part)
where category<>''
""")
def analysis_ready_subset(t):
    s = classify_struct(KIND_RULES, ("category", "endpoint", "direction", "rule"), kind="p_type", text="p_name")
    unit = F.when(F.col("p_size") <= 25, "cm").otherwise("")
    d = t.part.withColumns({"s": s, "unit": unit, "value_numeric": V.parse_numeric("p_size")})
    d = d.where(F.col("s.category") != "")
    flags = T.join_flags(
        F.array(F.when(F.col("value_numeric").isNull(), "missing_numeric"), F.when(F.col("unit") == "", "missing_unit"))
    )
    return d.select(
        "p_partkey",
        "s.category",
        "s.endpoint",
        "value_numeric",
        (F.col("value_numeric").isNotNull() & (F.col("unit") != "")).alias("is_ready"),
        flags.alias("flags"),
    ).distinct()


@query("year_bands", """
select coalesce((floor(y/5)*5)::bigint||'-'||((floor(y/5)*5)::bigint+4),'undated') as band, count(*) as n, min(y)::bigint as first_year
from (select list_min(list_transform(regexp_extract_all(txt,'(?:19|20)[0-9][0-9]'), lambda x: x::int)) as y
 from (select 'ref '||year(o_orderdate)||';'||(year(o_orderdate)+o_custkey%9) as txt from orders)) group by 1
""")
def year_bands(t):
    y = F.year("o_orderdate")
    txt = F.concat(F.lit("ref "), y.cast("string"), F.lit(";"), (y + F.col("o_custkey") % 9).cast("string"))
    d = t.orders.select(T.extract_year(txt).alias("y"))
    return d.groupBy(T.year_band("y").alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.min("y").cast("long").alias("first_year")
    )


@query("fixed_bins", """
select case when p_retailprice<=930 then 'low' when p_retailprice<=960 then 'mid' when p_retailprice<=1000 then 'high' else 'top' end as bin, count(*) as n from part group by 1
""")
def fixed_bins(t):
    b = V.ladder("p_retailprice", (930, 960, 1000), ("low", "mid", "high", "top"))
    return t.part.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("measurement_identity", """
select row_key, 'MEA-'||upper(substr(sha256(array_to_string([source,record_id,subject_id,assay_id,endpoint,document_id],chr(0))),1,24)) as measurement_id from @normalized
""")
def measurement_identity(t):
    fields = ("source", "record_id", "subject_id", "assay_id", "endpoint", "document_id")
    return G.measurement_ids(t.normalized, fields).select("row_key", "measurement_id")


@query("property_windows", """
select p_partkey, array_to_string(v,';') as violations, len(v)::bigint as n_violations, round(least(1.0,greatest(0.0,(p_size-10)/30.0)),6) as desirability from (
select *, list_filter([case when p_size<5 then 'p_size:below_min' when p_size>40 then 'p_size:above_max' end,
 case when p_retailprice>1500 then 'p_retailprice:above_max' end], lambda x: x is not null) as v from part)
""")
def property_windows(t):
    v = V.window_violations({"p_size": (5, 40), "p_retailprice": (None, 1500)})
    return t.part.select(
        "p_partkey",
        F.concat_ws(";", v).alias("violations"),
        F.size(v).cast("long").alias("n_violations"),
        F.round(V.ramp("p_size", 10, 40), 6).alias("desirability"),
    )


@query("interaction_features", """
select l_orderkey, l_linenumber, l_partkey, round(l_quantity*l_discount,6) as quantity_x_discount, round(abs(l_quantity*l_tax),6) as quantity_x_tax_abs from lineitem
""")
def interaction_features(t):
    from proofmill.operators.features import interactions

    d = interactions(
        t.lineitem,
        [("l_quantity", "l_discount", False, "quantity_x_discount"), ("l_quantity", "l_tax", True, "quantity_x_tax_abs")],
    )
    return d.select("l_orderkey", "l_linenumber", "l_partkey", *rnd("quantity_x_discount", "quantity_x_tax_abs"))


VIEWS["intervals"] = """
select o_orderkey, 'C'||o_custkey as subject, o_orderpriority as endpoint, case when o_orderstatus<>'F' then log10(o_totalprice)-0.1 end as lower,
 case when o_orderstatus<>'P' then log10(o_totalprice)+0.1 end as upper, log10(o_totalprice) as mid from orders
"""


def intervals(t):
    lp = F.log10("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        F.concat(F.lit("C"), F.col("o_custkey")).alias("subject"),
        F.col("o_orderpriority").alias("endpoint"),
        F.when(F.col("o_orderstatus") != "F", lp - 0.1).alias("lower"),
        F.when(F.col("o_orderstatus") != "P", lp + 0.1).alias("upper"),
        lp.alias("mid"),
    )


@query("interval_decision", """
select o_orderkey, case when lower>=5 then 1 when upper<=5 then 0 end as label,
 case when lower>=5 then 'lower_bound_reaches_threshold' when upper<=5 then 'upper_bound_below_threshold' else 'interval_spans_threshold' end as basis from @intervals
""")
def interval_decision(t):
    d = intervals(t).select("o_orderkey", V.interval_label("lower", "upper", 5.0, 5.0).alias("d"))
    return d.select("o_orderkey", "d.label", "d.basis")


@query("eligibility_gate", "select row_key, exclusion_reason, is_eligible from @gated")
def eligibility_gate(t):
    return t.gated.select("row_key", "exclusion_reason", "is_eligible")


ACCEPTED_COMMENTS = ("", "checked")


@query("full_gate", """
with d as (select *, split_part(row_key,':',1)::bigint as ok, split_part(row_key,':',2)::int as ln, split_part(row_key,':',3)::bigint as pk, split_part(row_key,':',4)::bigint as sk,
 row_number() over (partition by source,record_id,subject_id,assay_id,endpoint,relation,value_numeric,unit_normalized,document_id order by row_key)>1 as is_duplicate,
 coalesce(min(value_numeric) over r < max(value_numeric) over r, false) or coalesce(min(subject_id) over r < max(subject_id) over r, false) as record_conflict from (
  select * replace (case when pk0%41=0 then '' else subject_id end as subject_id, case when sk0%17=0 then '?' else relation end as relation, case when sk0%19=0 then -value_numeric else value_numeric end as value_numeric, case when ln0%2=1 and sk0%5=0 then 'R'||ok0 else record_id end as record_id)
  from (select *, split_part(row_key,':',1)::bigint as ok0, split_part(row_key,':',2)::int as ln0, split_part(row_key,':',3)::bigint as pk0, split_part(row_key,':',4)::bigint as sk0 from @normalized)) window r as (partition by source,record_id,endpoint)),
e as (select *, case when pk%37=0 then '' else 'C'||pk end as original, case when pk%31=0 then 'invalid_form' when pk%31=1 then 'failed' when pk%31=2 then 'unavailable' else 'standard' end as status, sk%23<>0 as relevant, case when sk%2=0 then 'off_target' when sk%3=0 then 'manual_exclude' else '' end as relevance,
 case when ok%29=0 then 0 when ok%29<>1 then 1 end as standard, case when ok%13=0 then ' Outside range' when ok%13=1 then 'CHECKED' else '' end as comment, case when ok%11=0 then 1 else 0 end as maybe, case when pk%43=0 then 'V12' else ' ' end as variant, p_value+case when ok%7=0 then 0.2 else 0.01 end as reported,
 case when ok%5=0 then 'hand_entered;late' when ok%5=1 then 'late' end as earlier from d),
f as (select *, [case when subject_id='' then 'missing_subject' end, case when value_numeric is null then 'missing_or_non_numeric_value' end, case when value_numeric<=0 then 'nonpositive_value' end, case when unit_status<>'converted' then unit_status end, case when endpoint not in ('urgent','high','medium','low') then 'unsupported_endpoint' end,
  case when relation not in ('<','<=','=','>=','>','~') then 'invalid_relation' end, case when is_duplicate then 'duplicate_measurement' end, case when record_conflict then 'source_record_conflict' end, case when abs(reported-p_value)>0.05 then 'conversion_mismatch' end,
  case when trim(original)='' then 'missing_structure' end, case when not relevant and relevance in ('off_target','manual_exclude') then 'target_not_relevant' end, case when not relevant and relevance not in ('off_target','manual_exclude') then 'target_relevance_unresolved' end,
  case when source='alpha' and (standard is null or standard<>1) then 'alpha_nonstandard_measurement' end, case when source='alpha' and lower(trim(comment)) not in ('','checked') then 'alpha_data_validity_warning' end, case when source='alpha' and maybe=1 then 'alpha_potential_duplicate' end, case when trim(variant)<>'' then 'variant_excluded' end] as shared,
  case when trim(original)<>'' and status in ('invalid_form','failed') then status end as bad from e),
g as (select *, list_filter(shared || [case when bad is not null then 'invalid_structure' end], lambda x: x is not null) as why, list_filter(shared || [bad, case when relation='~' then 'approximate_value' end, case when trim(original)<>'' and bad is null and status='unavailable' then 'structure_not_validated' end] || list_filter(string_split(coalesce(earlier,''),';'), lambda x: x<>''), lambda x: x is not null) as what from f)
select row_key, array_to_string(list_sort(list_distinct(what)),';') as quality_flags, array_to_string(list_sort(list_distinct(why)),';') as exclusion_reason, len(why)=0 as is_eligible, len(what)>0 as requires_review from g
""")
def full_gate(t):
    """Every kind of reason at once, on columns that are derived so that each occurs."""
    part = F.split("row_key", ":")
    ok, ln, pk, sk = (F.element_at(part, i).cast("long") for i in (1, 2, 3, 4))
    d = t.normalized.withColumns(
        {
            "subject_id": F.when(pk % 41 == 0, "").otherwise(F.col("subject_id")), "relation": F.when(sk % 17 == 0, "?").otherwise(F.col("relation")), "value_numeric": F.when(sk % 19 == 0, -F.col("value_numeric")).otherwise(F.col("value_numeric")),
            "record_id": F.when((ln % 2 == 1) & (sk % 5 == 0), F.concat(F.lit("R"), ok)).otherwise(F.col("record_id")),
            "original": F.when(pk % 37 == 0, "").otherwise(F.concat(F.lit("C"), pk)), "status": F.when(pk % 31 == 0, "invalid_form").when(pk % 31 == 1, "failed").when(pk % 31 == 2, "unavailable").otherwise("standard"),
            "relevant": sk % 23 != 0, "relevance": F.when(sk % 2 == 0, "off_target").when(sk % 3 == 0, "manual_exclude").otherwise(""),
            "standard": F.when(ok % 29 == 0, 0).when(ok % 29 != 1, 1), "comment": F.when(ok % 13 == 0, " Outside range").when(ok % 13 == 1, "CHECKED").otherwise(""), "maybe": F.when(ok % 11 == 0, 1).otherwise(0),
            "variant": F.when(pk % 43 == 0, "V12").otherwise(" "), "reported": F.col("p_value") + F.when(ok % 7 == 0, 0.2).otherwise(0.01), "earlier": F.when(ok % 5 == 0, "hand_entered;late").when(ok % 5 == 1, "late"),
        }
    )
    rules = (
        *G.structure_rules("original", "status", invalid=("invalid_form", "failed"), unchecked=("unavailable",)),
        *G.target_rules("relevant", "relevance", excluded=("off_target", "manual_exclude")),
        *G.curated_source_rules("source", "alpha", standard="standard", comment="comment", accepted=ACCEPTED_COMMENTS, duplicate="maybe"),
        *G.variant_rules("variant"),
    )
    g = G.gate(d, core_endpoints=CORE_ENDPOINTS, extra_rules=rules, reported_p="reported", carried="earlier")
    return g.select("row_key", "quality_flags", "exclusion_reason", "is_eligible", "requires_review")


@query("duplicate_flags", """
select row_key, is_duplicate from (select row_key, row_number() over (partition by subject_id,endpoint,relation,value_numeric,unit_normalized order by row_key)>1 as is_duplicate from @normalized)
""")
def duplicate_flags(t):
    f = ("subject_id", "endpoint", "relation", "value_numeric", "unit_normalized")
    return G.flag_duplicates(t.normalized, fields=f).select("row_key", "is_duplicate")


@query("record_conflicts", """
select row_key, coalesce(min(value_numeric) over r < max(value_numeric) over r,false) or coalesce(min(subject_id) over r < max(subject_id) over r,false) as record_conflict
from @normalized window r as (partition by source,record_id,endpoint)
""")
def record_conflicts(t):
    return G.flag_record_conflicts(t.normalized).select("row_key", "record_conflict")


@query("reported_mismatch", """
select row_key, abs(round(log10(l_extendedprice),1)-log10(l_extendedprice))>0.03 as mismatch
from (select l_orderkey||':'||l_linenumber||':'||l_partkey||':'||l_suppkey as row_key, l_extendedprice from lineitem)
""")
def reported_mismatch(t):
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lp = F.log10("l_extendedprice")
    return t.lineitem.select(key.alias("row_key"), (F.abs(F.round(lp, 1) - lp) > 0.03).alias("mismatch"))


@query("censoring_policy", """
select policy, count(*) as n, count(distinct subject_id) as n_subjects from (
 select 'strict_exact' as policy, subject_id from @gated where is_eligible and is_exact
 union all select 'include_all', subject_id from @gated where is_eligible
 union all select 'prefer_exact_per_subject', subject_id from (select *, bool_or(is_exact) over (partition by subject_id,endpoint) as he from @gated where is_eligible) where is_exact or not he)
group by policy
""")
def censoring_policy(t):
    # read by every policy, so gated once
    base = cut_lineage(t.gated.where("is_eligible").select("subject_id", "endpoint", "is_exact"))
    parts = []
    for p in ("strict_exact", "include_all", "prefer_exact_per_subject"):
        d = G.apply_censoring_policy(base, p, ["subject_id", "endpoint"])
        parts.append(d.select(F.lit(p).alias("policy"), "subject_id"))
    u = parts[0].unionAll(parts[1]).unionAll(parts[2])
    per = u.groupBy("policy", "subject_id").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("policy").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_subjects"))


@query("quarantine_split", """
select case when is_eligible then 'accepted' else 'rejected' end as side, source, count(*) as n from @gated group by 1,2
""")
def quarantine_split(t):
    ok, no = G.quarantine(cut_lineage(t.gated.select("source", "is_eligible")))
    u = ok.select(F.lit("accepted").alias("side"), "source").unionAll(no.select(F.lit("rejected").alias("side"), "source"))
    return u.groupBy("side", "source").agg(F.count(F.lit(1)).alias("n"))


@query("mirror_links", """
select row_key, is_mirror_candidate, is_mirror_redundant, mirror_preferred_source from @mirrored
""")
def mirror_links(t):
    return t.mirrored.select("row_key", "is_mirror_candidate", "is_mirror_redundant", "mirror_preferred_source")


AGG_SQL = """
select {by}, count(*) as n_source_rows, count_if(is_mirror_redundant) as n_mirror_rows_collapsed, count_if(k) as n_measurements,
 count_if(k and is_exact) as n_exact, count_if(k and is_censored) as n_censored, count_if(k and relation='~') as n_approximate,
 round(median(case when k then p_value end),6) as p_median, round(max(case when k then p_value end),6) as p_best, round(min(case when k then p_value end),6) as p_min,
 round(median(case when k then value_scaled end),6) as value_median, min(case when k then value_scaled end) as value_best,
 string_agg(distinct source, ';' order by source) as sources, count(distinct source) as n_sources,
 string_agg(distinct case when k then relation end, ';' order by case when k then relation end) as relations,
 string_agg(distinct case when k then endpoint end, ';' order by case when k then endpoint end) as endpoints,
 string_agg(distinct case when k then family end, ';' order by case when k then family end) as families,
 count(distinct case when k then family end) as n_families,
 array_to_string(list_sort(list(distinct case when k then yr::varchar end) filter (where k)),';') as years
from (select *, not is_mirror_redundant as k from ({src})) group by {by} having count_if(k)>0
"""
SUBJECT_FINAL = """
select *, round(p_best-p_min,5) as spread, (p_best-p_min>1.0000005) or n_families>1 as is_heterogeneous,
 case when n_exact=n_measurements then 'exact_point_estimate' when n_censored=n_measurements then 'censoring_thresholds_only'
  when n_approximate=n_measurements then 'approximate_points_only' else 'mixed_points_and_thresholds' end as semantics,
 case when value_median<=100 then 'class_1_le_100' when value_median<=1000 then 'class_2_le_1000' when value_median<=10000 then 'class_3_le_10000' else 'class_4_gt_10000' end as value_class
from ({agg})
"""
VIEWS["core_all"] = "select * from @mirrored where is_core_endpoint and value_scaled>0 and is_eligible"
VIEWS["core_exact"] = "select * from @core_all where is_exact"


def present(d):
    return d.withColumns(
        {
            **{c: F.round(c, 6) for c in ("p_median", "p_best", "p_min", "value_median")},
            "spread": F.round(F.round("p_best", 6) - F.round("p_min", 6), 5),
        }
    )


@query("subject_aggregate", SUBJECT_FINAL.format(agg=AGG_SQL.format(by="subject_id, endpoint", src="@core_all")))
def subject_aggregate(t):
    return present(A.aggregate_subjects(t.mirrored, by=("subject_id", "endpoint"), policy="include_all", cuts=t.value_cuts))


@query("subject_aggregate_exact", SUBJECT_FINAL.format(agg=AGG_SQL.format(by="subject_id", src="@core_exact")))
def subject_aggregate_exact(t):
    return present(A.aggregate_subjects(t.mirrored, by=("subject_id",), policy="strict_exact", cuts=t.value_cuts))


@query("source_summary", """
select source, count(*) as n_measurements, count(distinct subject_id) as n_subjects, count_if(is_eligible) as n_eligible from @gated group by source
""")
def source_summary(t):
    return A.source_summary(t.gated)


@query("exclusion_summary", """
select reason, count(*) as n_rows, count(distinct subject_id) as n_subjects from
 (select subject_id, unnest(string_split(case when exclusion_reason='' then 'eligible' else exclusion_reason end,';')) as reason from @gated) group by reason
""")
def exclusion_summary(t):
    return A.exclusion_summary(t.gated)
