"""Queries for grouped evidence: collapses, derived quantities, audits and report rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill.operators import aggregate as A
from proofmill.operators import evidence as E
from proofmill.plans.measurements import intervals, rnd
from proofmill.plans.registry import VIEWS, query


def ncdf_sql(z: str) -> str:
    t = f"(1.0/(1.0+0.3275911*(abs({z})/sqrt(2.0))))"
    poly = f"((((1.061405429*{t}-1.453152027)*{t}+1.421413741)*{t}-0.284496736)*{t}+0.254829592)*{t}"
    return f"(0.5*(1.0+sign({z})*(1.0-({poly})*exp(-({z})*({z})/2.0))))"


def rounded(df, digits=6, nudge=0.0):
    """Round doubles; a nudge moves exact decimal halves off the boundary where engines may differ."""
    return df.select(
        *[F.round(F.col(c) + nudge if nudge else F.col(c), digits).alias(c) if ty == "double" else F.col(c) for c, ty in df.dtypes]
    )


@query("dead_zone_labels", """
select p_partkey, case when p_retailprice<=940 then 1 when p_retailprice>=970 then 0 end as label from part
""")
def dead_zone_labels(t):
    return A.dead_zone_label(t.part, "p_retailprice", 940, 970).select("p_partkey", "label")


@query("conflict_free_labels", """
select subject, min(b)::int as label, count(*) as n_rows from (select 'C'||o_custkey as subject, (o_totalprice>300000)::int as b from orders)
group by subject having count(distinct b)=1
""")
def conflict_free_labels(t):
    d = t.orders.select(F.concat(F.lit("C"), "o_custkey").alias("subject"), (F.col("o_totalprice") > 300000).cast("int").alias("label"))
    return A.conflict_free_labels(d, "subject", "label")


@query("label_conflicts", """
select subject, count(*) as n_rows from (select 'C'||o_custkey as subject, (o_totalprice>300000)::int as b from orders)
group by subject having count(distinct b)>1
""")
def label_conflicts(t):
    d = t.orders.select(F.concat(F.lit("C"), "o_custkey").alias("subject"), (F.col("o_totalprice") > 300000).cast("int").alias("label"))
    return A.label_conflicts(d, "subject", "label")


@query("task_preparation", """
select subject_id, count(*) as n_measurements, round(median(p_value),6) as p_median, count_if(is_mirror_redundant) as n_mirrors from @mirrored
where endpoint='high' and family='F' and is_eligible and is_exact group by subject_id having round(max(p_value)-min(p_value),6)<=1.0
""")
def task_preparation(t):
    """Endpoint and family are filtered before aggregation: they change the label."""
    d = t.mirrored.where((F.col("endpoint") == "high") & (F.col("family") == "F") & F.col("is_eligible") & F.col("is_exact"))
    from proofmill.operators.ranking import quantile_of, rank_cells

    cells = d.groupBy("subject_id", "p_value").agg(
        F.count(F.lit(1)).alias("n_tied"), F.count_if("is_mirror_redundant").alias("m")
    )
    g = rank_cells(cells, "p_value", ["subject_id"]).groupBy("subject_id").agg(
        F.sum("n_tied").alias("n_measurements"),
        F.round(quantile_of("p_value", 0.5), 6).alias("p_median"),
        F.sum("m").alias("n_mirrors"),
        F.round(F.max("p_value") - F.min("p_value"), 6).alias("s"),
    )
    return g.where(F.col("s") <= 1.0).drop("s")


@query("replicate_aggregate", """
select subject_id, endpoint, case when ex then '=' when rlo=rhi then rlo else '~' end as relation,
 round(case when ex then med_ex when rlo=rhi and rlo in ('>','>=') then vmax when rlo=rhi and rlo in ('<','<=') then vmin else med_all end,6) as value,
 vmin as value_min, vmax as value_max, n as replicate_count, rlo<>rhi as mixed_censoring, n>1 and (rlo<>rhi or mr>0.5) as label_conflict
from (select subject_id, endpoint, bool_or(relation='=') as ex, min(relation) as rlo, max(relation) as rhi, count(*) as n, min(value_scaled) as vmin, max(value_scaled) as vmax,
 median(case when relation='=' then value_scaled end) as med_ex, median(value_scaled) as med_all, max(p_value)-min(p_value) as mr from @normalized where value_scaled is not null group by 1,2)
""")
def replicate_aggregate(t):
    return rounded(A.aggregate_replicates(t.measured, ["subject_id", "endpoint"], tolerance=0.5))


@query("interval_consensus", """
with u as (select distinct subject, round(lower,6) as lo, round(upper,6) as hi from @narrow), r as (select subject, count(*) as n_rows from @narrow group by 1),
g as (select subject, count(*) as n_intervals, count_if(coalesce(lo=hi,false)) as n_exact, max(case when lo=hi then lo end)-min(case when lo=hi then lo end) as es, median(case when lo=hi then lo end) as med,
 max(case when lo=hi then null else lo end) as cl, min(case when lo=hi then null else hi end) as ch from u where lo is not null or hi is not null group by 1),
f as (select g.*, n_rows, case when n_exact>0 and coalesce(med<cl-1e-8 or med>ch+1e-8,false) then 'exact_conflicts_with_censored' when n_exact>0 and es>0.3 then 'exact_spread_too_wide'
 when n_exact=0 and coalesce(cl>ch,false) then 'empty_intersection' else '' end as reason from g join r using(subject))
select subject, n_rows, n_intervals, n_exact, round(es+1e-9,6) as exact_spread, reason, round(case when reason='' then case when n_exact>0 then med else cl end end+1e-9,6) as lower,
 round(case when reason='' then case when n_exact>0 then med else ch end end+1e-9,6) as upper from f
""")
def interval_consensus(t):
    d = intervals(t)
    one = F.col("o_orderkey") % 6 == 0
    d = d.withColumns({"lower": F.when(one, F.col("mid")).otherwise(F.col("lower") - 0.8), "upper": F.when(one, F.col("mid")).otherwise(F.col("upper") + 0.8)})
    return rounded(A.interval_consensus(d, ["subject"], lower="lower", upper="upper"), nudge=1e-9)


VIEWS["narrow"] = "select subject, case when o_orderkey%6=0 then mid else lower-0.8 end as lower, case when o_orderkey%6=0 then mid else upper+0.8 end as upper from @intervals"


@query("geometric_collapse", """
select l_partkey, count(*) as n_signatures, round(avg(log10(l_quantity)),6) as mean_log10 from (select distinct l_partkey, l_quantity, l_returnflag, l_linestatus from lineitem) group by 1
""")
def geometric_collapse(t):
    d = t.lineitem.select("l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    return rounded(A.geometric_collapse(d, "l_partkey", "l_quantity", ["l_quantity", "l_returnflag", "l_linestatus"]))


@query("balanced_rows", """
select subject, count(*) as n_rows, round(avg(observed),6) as observed_mean, round(var_pop(observed),6) as observed_var, round(avg(predicted),6) as predicted_mean, round(var_pop(predicted),6) as predicted_var
from @predictions group by subject
""")
def balanced_rows(t):
    return rounded(A.balanced_rows(t.predictions, "subject", ["observed", "predicted"]))


@query("preferred_endpoint", """
select o_custkey, o_orderpriority, count(*) as n from (select *, min(p) over (partition by o_custkey) as b from (select *, case o_orderpriority when '1-URGENT' then 0 when '3-MEDIUM' then 1 else 2 end as p from orders))
where p=b group by 1,2
""")
def preferred_endpoint(t):
    d = A.pick_preferred(t.orders, ["o_custkey"], "o_orderpriority", ["1-URGENT", "3-MEDIUM"])
    return d.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def studies(t):
    ln = F.col("l_linenumber")
    return t.lineitem.where(ln <= 2).select(
        "l_orderkey",
        F.when(ln == 1, "iv").otherwise("po").alias("arm"),
        F.col("l_quantity").alias("dose"),
        F.col("l_extendedprice").alias("auc"),
        F.when(ln == 1, F.round(F.col("l_quantity") / F.col("l_extendedprice"), 4)).alias("reported_cl"),
        F.when(ln == 2, F.col("l_tax") * 1000).alias("reported_f"),
    )


@query("exposure_closure", """
with g as (select l_orderkey, max(case when l_linenumber=1 then l_quantity end) as iv_dose, max(case when l_linenumber=1 then l_extendedprice end) as iv_auc,
 max(case when l_linenumber=2 then l_quantity end) as po_dose, max(case when l_linenumber=2 then l_extendedprice end) as po_auc,
 max(case when l_linenumber=1 then round(l_quantity/l_extendedprice,4) end) as rc, max(case when l_linenumber=2 then l_tax*1000 end) as rf from lineitem where l_linenumber<=2 group by 1),
h as (select *, iv_dose/iv_auc as cl, 100.0*po_auc*iv_dose/(iv_auc*po_dose) as av from g),
k as (select *, abs(rc-cl)/greatest(abs(cl),1e-12) as ec, abs(rf-av) as ef from h)
select l_orderkey, round(cl+1e-9,6) as cl, round(av+1e-9,6) as availability, round(ec+1e-9,6) as cl_relative_error, round(ef+1e-9,6) as f_error_points,
 case when ec is null and ef is null then 'not_computable' when greatest(ec/0.05,ef/5.0)<=1 then 'closed' else 'open' end as status from k
""")
def exposure_closure(t):
    d = E.closure(studies(t), "l_orderkey")
    return rounded(d.select("l_orderkey", "cl", "availability", "cl_relative_error", "f_error_points", "status"), nudge=1e-9)


@query("derived_interval_views", """
select o_orderkey, round(lower,6) as lower, round(upper,6) as upper, round(case when upper>0 then 100.0/upper end,6) as reciprocal_lower, round(case when lower>0 then 100.0/lower end,6) as reciprocal_upper, round(mid/dose,6) as dose_normalized
from @intervals join (select l_orderkey, max(l_quantity) as dose from lineitem group by 1) on l_orderkey=o_orderkey
""")
def derived_interval_views(t):
    dose = t.lineitem.groupBy("l_orderkey").agg(F.max("l_quantity").alias("dose"))
    d = intervals(t).join(dose, F.col("o_orderkey") == F.col("l_orderkey"))
    lo, hi = E.reciprocal_interval(100.0, "lower", "upper")
    return rounded(
        d.select("o_orderkey", "lower", "upper", lo.alias("reciprocal_lower"), hi.alias("reciprocal_upper"), (F.col("mid") / F.col("dose")).alias("dose_normalized"))
    )


@query("exposure_margin", """
select l_orderkey, l_linenumber, l_partkey, round(case when l_extendedprice>0 and l_quantity>0 and l_tax>0 then l_extendedprice/(l_quantity*l_tax) end,6) as margin from lineitem
""")
def exposure_margin(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(E.margin("l_extendedprice", "l_quantity", "l_tax"), 6).alias("margin")
    )


@query("protocol_completeness", """
select family, n_rows, field, n_present, round(n_present/n_rows,6) as fraction from (select family, count(*) as n_rows, count(nullif(unit,'')) as unit, count(nullif(relation,'')) as relation, count(nullif(value_text,'')) as value_text from @raw group by family)
 unpivot (n_present for field in (unit, relation, value_text))
""")
def protocol_completeness(t):
    return rounded(A.completeness(t.raw, ["family"], ["unit", "relation", "value_text"]))


@query("source_echo", """
select endpoint, sum(n)::bigint as n_rows, count(*) as n_signatures, count_if(n>1) as n_repeated_signatures, sum(case when n>1 then n else 0 end)::bigint as n_rows_in_repeats, max(n) as largest_repeat
from (select endpoint, count(*) as n from @raw group by endpoint, subject_id, value_text, unit, relation) group by endpoint
""")
def source_echo(t):
    return A.signature_echo(t.raw, "endpoint", ["subject_id", "value_text", "unit", "relation"])


@query("measurement_dispersion", """
select endpoint, count(*) as n_subjects, count_if(n>=2) as n_repeated, round(max(case when n>=2 then r end),6) as max_range, round(avg(case when n>=2 then s end),6) as mean_sd, round(median(case when n>=2 then r end),6) as median_range
from (select endpoint, subject_id, count(*) as n, max(p_value)-min(p_value) as r, stddev_samp(p_value) as s from @normalized where p_value is not null group by 1,2) group by 1
""")
def measurement_dispersion(t):
    return rounded(E.dispersion(t.measured, "subject_id", "endpoint", "p_value"))


@query("selection_bias", f"""
with long as (select l_returnflag='A' as on_, feature, value from (select l_returnflag, l_quantity, l_tax, l_discount from lineitem) unpivot (value for feature in (l_quantity, l_tax, l_discount))),
r as (select *, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value)-1)/2.0 as rk, count(*) over (partition by feature, value) as tc from long),
m as (select feature, count_if(on_) as n1, count_if(not on_) as n0, avg(case when on_ then value end) as m1, avg(case when not on_ then value end) as m0, var_samp(case when on_ then value end) as v1,
 var_samp(case when not on_ then value end) as v0, sum(case when on_ then rk end)::double as rs, sum(tc::double*tc-1) as ties from r group by 1),
z as (select *, rs-n1*(n1+1)/2.0 as u, (rs-n1*(n1+1)/2.0-n1::double*n0/2.0)/sqrt(n1::double*n0/12.0*((n1+n0+1)-ties/((n1+n0)::double*(n1+n0-1)))) as z from m),
p as (select *, 2*(1-{ncdf_sql("abs(z)")}) as p from z),
q as (select *, rank() over (order by p) + count(*) over (partition by p) - 1 as rk from p)
select feature, n1 as n_available, n0 as n_missing, round((m1-m0)/sqrt((v1+v0)/2),6) as smd, u as u_statistic, round(z,6) as z, round(p,6) as p,
 round(least(1.0, min(p*3/rk) over (order by p desc)),6) as q from q
""")
def selection_bias(t):
    d = t.lineitem.withColumn("on", F.col("l_returnflag") == "A")
    return rounded(E.selection_bias(d, "on", ["l_quantity", "l_tax", "l_discount"]))


@query("hill_consistency", """
select l_orderkey, l_linenumber, l_partkey, round(100.0*l_quantity/(l_quantity+med),6) as expected, round(l_discount*1000-100.0*l_quantity/(l_quantity+med),6) as deviation
from lineitem join (select l_partkey as k, median(l_quantity) as med from lineitem group by 1) on k=l_partkey
""")
def hill_consistency(t):
    d = t.lineitem.withColumn("resp", F.col("l_discount") * 1000)
    h = E.hill_consistency(d, "l_partkey", "l_quantity", "resp", "l_quantity")
    return h.select("l_orderkey", "l_linenumber", "l_partkey", *rnd("expected", "deviation"))


@query("support_diversity", """
select endpoint, count(*) as n_members, round(sum(n)*sum(n)/sum(n*n),6) as effective_members, max(n) as largest_member, count_if(n=1) as singleton_members from
(select endpoint, document_id, count(*) as n from @normalized group by 1,2) group by 1
""")
def support_diversity(t):
    return rounded(A.simpson_support(t.normalized, ["endpoint"], "document_id"))


@query("series_summary", """
select p_brand, count(*) as n_subjects, round(median(p_retailprice),6) as value_median, max(p_retailprice) as value_max, round(max(p_retailprice)-min(p_retailprice),6) as value_range from part group by 1 having count(*)>=2
""")
def series_summary(t):
    from proofmill.operators.ranking import group_quantiles, null_safe_join

    g = t.part.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n_subjects"),
        F.max("p_retailprice").alias("value_max"),
        (F.max("p_retailprice") - F.min("p_retailprice")).alias("value_range"),
    )
    med = group_quantiles(t.part, "p_retailprice", {"value_median": 0.5}, ["p_brand"])
    return rounded(null_safe_join(g.where("n_subjects >= 2"), med, ["p_brand"]))


@query("weighted_ensemble", """
with c as (select l_orderkey, l_extendedprice as x, l_quantity as w, sum(l_quantity) over (partition by l_orderkey order by l_extendedprice range between unbounded preceding and current row) as cw, sum(l_quantity) over (partition by l_orderkey) as tw from lineitem)
select l_orderkey, count(*) as n_members, round(sum(w*x)/sum(w)+1e-6,4) as mean, round(sqrt(greatest(0.0,sum(w*x*x)/sum(w)-(sum(w*x)/sum(w))*(sum(w*x)/sum(w))))+1e-4,2) as sd,
 min(case when cw>=0.05*tw then x end) as q05, min(case when cw>=0.5*tw then x end) as q50, min(case when cw>=0.95*tw then x end) as q95,
 round(sum(w)*sum(w)/sum(w*w),6) as effective_count, round(ln(sum(w))-sum(w*ln(w))/sum(w),6) as entropy, min(x) as value_min, max(x) as value_max, round(max(x)-min(x),4) as span
from c group by 1
""")
def weighted_ensemble(t):
    d = E.weighted_ensemble(t.lineitem, ["l_orderkey"], "l_extendedprice", "l_quantity")
    return d.withColumns(
        {
            "mean": F.round(F.col("mean") + 1e-6, 4),
            "sd": F.round(F.col("sd") + 1e-4, 2),
            "span": F.round("span", 4),
            "effective_count": F.round("effective_count", 6),
            "entropy": F.round("entropy", 6),
        }
    )


@query("boltzmann_weights", """
select l_orderkey, l_linenumber, l_partkey, round(b/sum(b) over (partition by l_orderkey),6) as weight from
(select *, exp(-(l_quantity-min(l_quantity) over (partition by l_orderkey))/10.0) as b from lineitem)
""")
def boltzmann_weights(t):
    d = E.boltzmann(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_orderkey"], "l_quantity", 10.0)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", *rnd("weight"))


@query("batch_offsets", """
with a as (select row_id, observed, stratum, fold, grp, observed-median(observed) over (partition by subject) as r0 from @predictions),
b as (select *, r0-sum(r0) over (partition by stratum)/(count(*) over (partition by stratum)+35.0) as r1 from a),
c as (select *, r1-sum(r1) over (partition by fold)/(count(*) over (partition by fold)+45.0) as r2 from b),
d as (select *, r2-sum(r2) over (partition by grp)/(count(*) over (partition by grp)+50.0) as r3 from c)
select row_id, round(r0-r3,6) as total_offset, round(observed-(r0-r3),6) as corrected from d
""")
def batch_offsets(t):
    d = E.batch_offsets(t.predictions, "observed", "subject", {"stratum": 35.0, "fold": 45.0, "grp": 50.0})
    return d.select("row_id", *rnd("total_offset", "corrected"))


@query("feature_qc", """
select feature, 0::bigint as n_missing, min(case when tr then v end)=max(case when tr then v end) as constant_in_train,
 round((avg(case when not tr then v end)-avg(case when tr then v end))/stddev_samp(case when tr then v end),6) as mean_shift
from (select l_orderkey%5<>0 as tr, feature, v from (select l_orderkey, l_quantity, l_discount, l_tax from lineitem) unpivot (v for feature in (l_quantity, l_discount, l_tax))) group by 1
""")
def feature_qc(t):
    d = t.lineitem.withColumn("train", F.col("l_orderkey") % 5 != 0)
    return rounded(E.feature_qc(d, ["l_quantity", "l_discount", "l_tax"], "train"))


@query("redundant_columns", """
with m as (select corr(l_quantity,l_extendedprice) as a, corr(l_quantity,l_discount) as b, corr(l_quantity,l_tax) as c, corr(l_extendedprice,l_discount) as d, corr(l_extendedprice,l_tax) as e, corr(l_discount,l_tax) as f from lineitem)
select * from (select 'l_quantity' as "left", 'l_extendedprice' as "right", round(a,6) as r from m union all select 'l_quantity','l_discount',round(b,6) from m union all select 'l_quantity','l_tax',round(c,6) from m
union all select 'l_extendedprice','l_discount',round(d,6) from m union all select 'l_extendedprice','l_tax',round(e,6) from m union all select 'l_discount','l_tax',round(f,6) from m) where abs(r)>=0.005
""")
def redundant_columns(t):
    return rounded(E.correlated_pairs(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 0.005))


@query("alias_conflicts", """
select o_custkey, min(o_clerk) as alias_min, max(o_clerk) as alias_max, min(o_totalprice) as value_min, max(o_totalprice) as value_max, count(*) as n_rows
from (select *, o_orderstatus as o_clerk from orders) group by 1 having min(o_clerk)<max(o_clerk) and min(o_totalprice)<max(o_totalprice)
""")
def alias_conflicts(t):
    return E.alias_conflicts(t.orders, "o_custkey", "o_orderstatus", "o_totalprice")


@query("alias_lists", """
select subject_id, array_to_string(list_sort(list(distinct document_id)),';') as documents, array_to_string(list_sort(list(distinct unit) filter (where unit<>'')),';') as units from @raw group by 1
""")
def alias_lists(t):
    d = A.joined_uniques(t.raw, ["subject_id"], {"documents": "document_id", "units": "unit"})
    return d


@query("coalition_interactions", """
with v as (select (l_suppkey%16)::int as mask, avg(l_extendedprice) as v from lineitem group by 1), p as (select i, j from range(4) a(i), range(4) b(j) where i<j)
select i::int as i, j::int as j, round(avg(case when ((mask>>i)&1)=((mask>>j)&1) then v else -v end)*4,4) as interaction from v, p group by 1,2
""")
def coalition_interactions(t):
    d = t.lineitem.groupBy((F.col("l_suppkey") % 16).cast("int").alias("mask")).agg(F.avg("l_extendedprice").alias("v"))
    return rounded(E.banzhaf_pairs(d, "mask", "v", 4), 4)


@query("sample_size", """
select endpoint, count(*) as n_subjects, round(stddev_samp(m),6) as sd, ceil(pow(1.96*stddev_samp(m)/0.05,2))::bigint as required_n from
(select endpoint, subject_id, avg(p_value) as m from @normalized where p_value is not null group by 1,2) group by 1
""")
def sample_size(t):
    return rounded(E.sample_size(t.normalized, "subject_id", "endpoint", "p_value", 0.05))


@query("threshold_mass", """
select l_returnflag, threshold::double as threshold, count_if(l_discount>=threshold) as n_at_or_above, round(sum(case when l_discount>=threshold then l_quantity else 0 end),4) as retained_mass, round(sum(case when l_discount<threshold then l_quantity else 0 end),4) as omitted_mass
from lineitem, (values (0.02),(0.05),(0.08)) v(threshold) group by 1,2
""")
def threshold_mass(t):
    return rounded(E.threshold_mass(t.lineitem, ["l_returnflag"], "l_discount", "l_quantity", (0.02, 0.05, 0.08)), 4)


@query("prefix_convergence", """
select l_orderkey, n_members, round(m1+1e-9,6) as mean_at_1, round(m2+1e-9,6) as mean_at_2, round(m4+1e-9,6) as mean_at_4, round(m8+1e-9,6) as mean_at_8, round(abs(m8-m4)+1e-9,6) as last_change, round(abs(m4-m2)+1e-9,6) as previous_change, greatest(abs(m8-m4),abs(m4-m2))>0.01 as escalate
from (select l_orderkey, count(*) as n_members, sum(case when l_linenumber<=1 then l_quantity*l_discount end)/sum(case when l_linenumber<=1 then l_quantity end) as m1,
 sum(case when l_linenumber<=2 then l_quantity*l_discount end)/sum(case when l_linenumber<=2 then l_quantity end) as m2,
 sum(case when l_linenumber<=4 then l_quantity*l_discount end)/sum(case when l_linenumber<=4 then l_quantity end) as m4,
 sum(case when l_linenumber<=8 then l_quantity*l_discount end)/sum(case when l_linenumber<=8 then l_quantity end) as m8 from lineitem group by 1)
""")
def prefix_convergence(t):
    return rounded(E.prefix_convergence(t.lineitem, ["l_orderkey"], "l_linenumber", "l_discount", "l_quantity", (1, 2, 4, 8), 0.01), nudge=1e-9)


@query("endpoint_coverage", """
select process, count(distinct subject_id) as n_subjects, count(*) as n_rows from (select subject_id, case when endpoint in ('urgent','high') then 'fast' when endpoint in ('medium','low') then 'slow' else 'other' end as process from @normalized) group by 1
""")
def endpoint_coverage(t):
    from proofmill.functions.values import lookup

    m = F.coalesce(lookup(F.col("endpoint"), {"urgent": "fast", "high": "fast", "medium": "slow", "low": "slow"}), F.lit("other"))
    per = t.normalized.groupBy(m.alias("process"), "subject_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("process").agg(F.count(F.lit(1)).alias("n_subjects"), F.sum("n").alias("n_rows"))


@query("metric_ladder", """
select p_partkey, case when p_size>40 then 'size' when p_retailprice>950 then 'price' else 'key' end as metric_name, case when p_size>40 then p_size::double when p_retailprice>950 then p_retailprice else p_partkey::double end as metric_value from part
""")
def metric_ladder(t):
    d = t.part.select(
        "p_partkey",
        F.when(F.col("p_size") > 40, F.col("p_size")).alias("size"),
        F.when(F.col("p_retailprice") > 950, F.col("p_retailprice")).alias("price"),
        F.col("p_partkey").alias("key"),
    )
    return E.metric_ladder(d, ["size", "price", "key"]).select("p_partkey", "metric_name", "metric_value")


@query("gate_admissibility", """
with g as (select l_partkey, count(*) as n, stddev_samp(l_quantity) as sd, max(l_discount) as md from lineitem group by 1)
select l_partkey, (case when not coalesce(sd<=17,false) then 1 else 0 end + case when not (md>=0.09) then 1 else 0 end)::bigint as substantive_failures, (case when not (n>=25) then 1 else 0 end)::bigint as sampling_failures,
 case when not coalesce(sd<=17,false) or not (md>=0.09) then 'reject' when not (n>=25) then 'extend_sampling' else 'admit' end as decision from g
""")
def gate_admissibility(t):
    g = t.lineitem.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("l_quantity").alias("sd"), F.max("l_discount").alias("md")
    )
    gates = E.gate_table(
        g,
        "l_partkey",
        [("spread", "sd", "<=", 17, "substantive"), ("reach", "md", ">=", 0.09, "substantive"), ("support", "n", ">=", 25, "sampling")],
    )
    return E.admissibility(gates, "l_partkey")


@query("logistic_rollup", """
select l_partkey, max(l_discount) as top, count(*) as n, round(1/(1+pow(10,0.05-max(l_discount))),6) as fraction from lineitem group by 1
""")
def logistic_rollup(t):
    g = t.lineitem.groupBy("l_partkey").agg(F.max("l_discount").alias("top"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("fraction", F.round(1 / (1 + F.pow(F.lit(10.0), F.lit(0.05) - F.col("top"))), 6))


@query("external_compatibility", """
select endpoint, unit, count(distinct subject_id) as n_subjects, case when count(distinct subject_id)>=1500 then 'compatible' else 'insufficient_subjects' end as decision from @raw group by 1,2
""")
def external_compatibility(t):
    per = t.raw.select("endpoint", "unit", "subject_id").distinct()
    g = per.groupBy("endpoint", "unit").agg(F.count(F.lit(1)).alias("n_subjects"))
    return g.withColumn("decision", F.when(F.col("n_subjects") >= 1500, "compatible").otherwise("insufficient_subjects"))


@query("data_inventory", """
select endpoint, count(*) as n_rows, count_if(relation='=') as n_exact, count_if(relation in ('<','<=','>','>=')) as n_censored, string_agg(distinct source, ';' order by source) as sources, string_agg(distinct family, ';' order by family) as families from @normalized group by 1
""")
def data_inventory(t):
    from proofmill.functions.text import join_set

    return t.normalized.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("is_exact").alias("n_exact"),
        F.count_if("is_censored").alias("n_censored"),
        join_set("source").alias("sources"),
        join_set("family").alias("families"),
    )


@query("overlap_audit", """
select role, status, count(*) as n from (select case when l_orderkey%5=0 then 'score' else 'train' end as role, case when exists(select 1 from lineitem b where b.l_partkey=a.l_partkey and b.l_orderkey%5<>0 and b.l_quantity=a.l_quantity) then 'in_sample' else 'new' end as status from lineitem a) group by 1,2
""")
def overlap_audit(t):
    d = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity").withColumn("role", F.when(F.col("l_orderkey") % 5 == 0, "score").otherwise("train"))
    seen = d.where("role = 'train'").select("l_partkey", "l_quantity").distinct().withColumn("seen", F.lit(True))
    j = d.join(seen, ["l_partkey", "l_quantity"], "left")
    j = j.withColumn("status", F.when(F.col("seen"), "in_sample").otherwise("new"))
    return j.groupBy("role", "status").agg(F.count(F.lit(1)).alias("n"))


@query("readiness_checklist", """
with g as (select count(*) as n, count(distinct source) as s, count_if(is_eligible)/count(*) as e, max(case when is_eligible and value_scaled is null then 1 else 0 end) as b from @gated)
select criterion, satisfied, case when satisfied then 'none' else action end as action from (
select 'enough_rows' as criterion, n>=1000 as satisfied, 'collect more rows' as action from g union all select 'several_sources', s>=2, 'add a source' from g
union all select 'eligible_share', e>=0.5, 'review gates' from g union all select 'no_unscaled_eligible', b=0, 'fix units' from g)
""")
def readiness_checklist(t):
    g = t.gated.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_eligible").alias("e"),
        F.max(F.when(F.col("is_eligible") & F.col("value_scaled").isNull(), 1).otherwise(0)).alias("b"),
    ).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("s"), F.sum("e").alias("e"), F.max("b").alias("b"))
    rows = [
        ("enough_rows", F.col("n") >= 1000, "collect more rows"),
        ("several_sources", F.col("s") >= 2, "add a source"),
        ("eligible_share", F.col("e") / F.col("n") >= 0.5, "review gates"),
        ("no_unscaled_eligible", F.col("b") == 0, "fix units"),
    ]
    items = F.array(*[F.struct(F.lit(a).alias("criterion"), c.alias("satisfied"), F.when(c, "none").otherwise(x).alias("action")) for a, c, x in rows])
    return g.select(F.explode(items).alias("x")).select("x.*")


@query("missingness_report", """
select field, n_missing, round(n_missing/60000.0*60000.0/n,6) as fraction from (select count(*) as n, count_if(value_numeric is null) as value_numeric, count_if(unit_normalized='') as unit_normalized, count_if(p_value is null) as p_value from @normalized)
unpivot (n_missing for field in (value_numeric, unit_normalized, p_value))
""")
def missingness_report(t):
    d = A.completeness(t.normalized.withColumn("all", F.lit("x")), ["all"], ["value_numeric", "unit_normalized", "p_value"])
    return d.select("field", (F.col("n_rows") - F.col("n_present")).alias("n_missing"), F.round(1 - F.col("fraction"), 6).alias("fraction"))


@query("attrition_report", """
select stage, n_rows, n_subjects from (
select 'all' as stage, count(*) as n_rows, count(distinct subject_id) as n_subjects from @mirrored union all select 'core', count_if(is_core_endpoint), count(distinct case when is_core_endpoint then subject_id end) from @mirrored
union all select 'eligible', count_if(is_eligible), count(distinct case when is_eligible then subject_id end) from @mirrored
union all select 'non_redundant', count_if(is_eligible and not is_mirror_redundant), count(distinct case when is_eligible and not is_mirror_redundant then subject_id end) from @mirrored)
""")
def attrition_report(t):
    st = {
        "all": F.lit(True),
        "core": F.col("is_core_endpoint"),
        "eligible": F.col("is_eligible"),
        "non_redundant": F.col("is_eligible") & ~F.col("is_mirror_redundant"),
    }
    per = t.mirrored.groupBy("subject_id").agg(*[F.count_if(c).alias(k) for k, c in st.items()])
    one = per.agg(
        *[F.sum(k).alias(f"{k}_r") for k in st], *[F.count_if(F.col(k) > 0).alias(f"{k}_s") for k in st]
    )
    items = F.array(*[F.struct(F.lit(k).alias("stage"), F.col(f"{k}_r").alias("n_rows"), F.col(f"{k}_s").alias("n_subjects")) for k in st])
    return one.select(F.explode(items).alias("x")).select("x.*")


@query("source_by_endpoint", """
select source, endpoint, family, count(*) as n_rows, count(distinct subject_id) as n_subjects, count_if(is_eligible) as n_eligible from @gated group by 1,2,3
""")
def source_by_endpoint(t):
    per = t.gated.groupBy("source", "endpoint", "family", "subject_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_eligible").alias("e")
    )
    return per.groupBy("source", "endpoint", "family").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_subjects"), F.sum("e").alias("n_eligible")
    )


@query("period_performance", """
select (floor(year(l_shipdate)/5)*5)::bigint||'-'||((floor(year(l_shipdate)/5)*5)::bigint+4) as band, count(*) as n, round(avg(abs(observed-predicted)),6) as mae, round(sqrt(avg((observed-predicted)*(observed-predicted))),6) as rmse
from @predictions join (select l_orderkey||':'||l_linenumber||':'||l_partkey||':'||l_suppkey as row_id, l_shipdate from lineitem) using(row_id) group by 1
""")
def period_performance(t):
    from proofmill.functions.text import year_band

    d = t.lineitem.select(
        year_band(F.year("l_shipdate")).alias("band"),
        (F.round(F.log10("l_extendedprice"), 4) - F.round(F.log10(F.col("l_quantity") * 3000), 4)).alias("e"),
    )
    return d.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs("e")), 6).alias("mae"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rmse")
    )
