"""Queries for metrics, ranks, splits and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill.functions.draws import hash_text
from proofmill.operators import metrics as M
from proofmill.operators import ranking as R
from proofmill.operators import resample as S
from proofmill.operators import splits as P
from proofmill.plans.aggregates import ncdf_sql, rounded
from proofmill.plans.measurements import rnd
from proofmill.plans.regimes import poisson_sql
from proofmill.plans.registry import VIEWS, query

VIEWS["err"] = "select *, observed-predicted as e, abs(observed-predicted) as ae, abs(observed-baseline) as be from @predictions"


def errors(t):
    return t.predictions.withColumns(
        {
            "e": F.col("observed") - F.col("predicted"),
            "ae": F.abs(F.col("observed") - F.col("predicted")),
            "be": F.abs(F.col("observed") - F.col("baseline")),
        }
    )


@query("regression_metrics", """
with r as (select *, rank() over (partition by stratum order by observed)+(count(*) over (partition by stratum, observed)-1)/2.0 as ro, rank() over (partition by stratum order by predicted)+(count(*) over (partition by stratum, predicted)-1)/2.0 as rp from @err)
select stratum, count(*) as n, round(avg(ae),6) as mae, round(sqrt(avg(e*e)),6) as rmse, round(1-sum(e*e)/(var_pop(observed)*count(*)),6) as r2, round(corr(observed,predicted),6) as pearson, round(corr(ro,rp),6) as spearman,
 round(avg(e),6) as mean_signed_error, round(avg((ae<=0.5)::int),6) as within_half, round(avg((ae<=1.0)::int),6) as within_one, round(regr_slope(observed,predicted),6) as calibration_slope, round(regr_intercept(observed,predicted),6) as calibration_intercept,
 round(median(ae)+1e-9,6) as median_absolute_error from r group by 1
""")
def regression_metrics(t):
    m = M.regression_metrics(t.predictions, "observed", "predicted", ["stratum"])
    return rounded(m.withColumn("median_absolute_error", F.col("median_absolute_error") + 1e-9))


@query("log_scale_metrics", f"""
with z as (select *, -e/sigma as z, pow(10,ae) as fe, sigma*1.645 as h from @err)
select stratum, count(*) as n, round(avg(fe),5) as average_fold_error, round(avg((fe<=2.0000002)::int),6) as within_2fold, round(avg((fe<=3.0000003)::int),6) as within_3fold, round(avg((ae<=h)::int),6) as coverage, round(avg(2*h),6) as mean_width,
 round(avg(ln(sigma)+0.5*z*z+0.9189385332046727),5) as nll, round(avg(sigma*(z*(2*{ncdf_sql("z")}-1)+2*exp(-z*z/2)/sqrt(2*3.141592653589793)-0.5641895835477563)),6) as crps, round(median(fe)+1e-7,5) as median_fold_error from z group by 1
""")
def log_scale_metrics(t):
    m = M.log_scale_metrics(t.predictions, "observed", "predicted", "sigma", F.col("sigma") * 1.645, ["stratum"])
    m = m.withColumn("median_fold_error", F.col("median_fold_error") + 1e-7)
    five = ("average_fold_error", "nll", "median_fold_error")
    return rounded(m.withColumns({c: F.round(c, 5) for c in five}))


@query("classification_metrics", """
with s as (select label as y, score as p from @scores), c as (select count(*) as n, count_if(p>=0.5 and y=1) as tp, count_if(p>=0.5 and y=0) as fp, count_if(p<0.5 and y=1) as fn, count_if(p<0.5 and y=0) as tn, avg((p-y)*(p-y)) as brier, avg(-case when y=1 then ln(p) else ln(1-p) end) as ll from s),
 d as (select p, count(*) as k, sum(y) as ky from s group by 1), r as (select *, sum(k) over (order by p)-k as nb, sum(ky) over (order by p)-ky as yb from d),
 a as (select sum(ky*((nb-yb)+(k-ky)/2.0))/((select sum(ky) from d)*(select sum(k-ky) from d)) as auc, sum(ky*((select sum(ky) from d)-yb)/((select sum(k) from d)-nb))/(select sum(ky) from d) as ap from r)
select n, tp, fp, fn, tn, round(brier,6) as brier, round(ll,6) as log_loss, round((tp+tn)/n,6) as accuracy, round(tp/(tp+fp),6) as precision, round(tp/(tp+fn),6) as sensitivity, round(tn/(tn+fp),6) as specificity, round((tp/(tp+fn)+tn/(tn+fp))/2,6) as balanced_accuracy, round(2.0*tp/(2*tp+fp+fn),6) as f1,
 round((tp::double*tn-fp::double*fn)/sqrt((tp+fp)::double*(tp+fn)*(tn+fp)*(tn+fn)),6) as mcc, round(auc,6) as roc_auc, round(ap,6) as average_precision from c, a
""")
def classification_metrics(t):
    return rounded(M.classification_metrics(t.scores, "label", "score"))


@query("calibration_curve", """
select b.bin::int as bin, count(score) as n, round(avg(score),6) as mean_score, round(avg(label),6) as observed_rate from range(10) b(bin)
left join (select *, (score>0.1)::int+(score>0.2)::int+(score>0.3)::int+(score>0.4)::int+(score>0.5)::int+(score>0.6)::int+(score>0.7)::int+(score>0.8)::int+(score>0.9)::int as bin from @scores) s on s.bin=b.bin group by 1
""")
def calibration_curve(t):
    return rounded(M.calibration_curve(t.scores, "label", "score", 10))


@query("expected_calibration_error", """
select round(sum(n*abs(o-m))/sum(n),6) as ece, sum(n)::bigint as n from (select count(*) as n, avg(score) as m, avg(label) as o from @scores
 group by (score>0.125)::int+(score>0.25)::int+(score>0.375)::int+(score>0.5)::int+(score>0.625)::int+(score>0.75)::int+(score>0.875)::int)
""")
def expected_calibration_error(t):
    return rounded(M.expected_calibration_error(t.scores, "label", "score", 8))


CAL_BINS = """select greatest(1,ceil((rk-1)*5.0/(n-1)))::int as bin, count(*) as n, avg(score) as mean_score, sum(label)::bigint as positives, min(score) as score_min, max(score) as score_max
 from (select *, row_number() over (order by score, doc_id) as rk, count(*) over () as n from @scores) group by 1"""


@query("calibration_bins_wilson", f"""
select bin, n, round(mean_score,6) as mean_score, positives, score_min, score_max, round(p,6) as observed_rate,
 round(greatest(0.0,(p+z*z/(2*n))/(1+z*z/n)-z*sqrt(p*(1-p)/n+z*z/(4.0*n*n))/(1+z*z/n)),6) as wilson_lower, round(least(1.0,(p+z*z/(2*n))/(1+z*z/n)+z*sqrt(p*(1-p)/n+z*z/(4.0*n*n))/(1+z*z/n)),6) as wilson_upper
from (select *, positives/n as p, 1.959963984540054::double as z from ({CAL_BINS}))
""")
def calibration_bins_wilson(t):
    return rounded(M.calibration_bins(t.scores, "label", "score", "doc_id", 5))


@query("brier_decomposition", f"""
select sum(n)::bigint as n, round(sum(positives)/sum(n),6) as prevalence, round(sum(n*pow(mean_score-positives/n,2))/sum(n),6) as reliability,
 round(sum(n*pow(positives/n,2))/sum(n)-pow(sum(positives)/sum(n),2),6) as resolution, round(sum(positives)/sum(n)*(1-sum(positives)/sum(n)),6) as uncertainty from ({CAL_BINS})
""")
def brier_decomposition(t):
    return rounded(M.brier_decomposition(M.calibration_bins(t.scores, "label", "score", "doc_id", 5)))


@query("interval_score_by_quartile", """
select bin, count(*) as n, round(avg((observed between lo and hi)::int),6) as coverage, round(avg((hi-lo)+20.0*(greatest(lo-observed,0)+greatest(observed-hi,0))),6) as mean_score
from (select *, greatest(1,ceil((row_number() over (order by sigma, row_id)-1)*4.0/(count(*) over ()-1)))::int as bin, predicted-1.645*sigma as lo, predicted+1.645*sigma as hi from @predictions) group by 1
""")
def interval_score_by_quartile(t):
    d = t.predictions.withColumns({"lo": F.col("predicted") - 1.645 * F.col("sigma"), "hi": F.col("predicted") + 1.645 * F.col("sigma")})
    b = R.equal_count_bins(d, "sigma", "row_id", 4, "bin")
    g = b.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("observed").between(F.col("lo"), F.col("hi")).cast("double")).alias("coverage"),
        F.avg(M.interval_score("observed", "lo", "hi", 0.1)).alias("mean_score"),
    )
    return rounded(g)


@query("censored_likelihood", f"""
select stratum, count(*) as n, round(avg(nll),5) as mean_nll from (select stratum, case when lo=hi then ln(sigma)+0.5*zl*zl+0.9189385332046727 when lo is not null and hi is not null then -ln(greatest({ncdf_sql("zh")}-{ncdf_sql("zl")},1e-12))
 when lo is not null then -ln(greatest(1-{ncdf_sql("zl")},1e-12)) when hi is not null then -ln(greatest({ncdf_sql("zh")},1e-12)) end as nll
 from (select stratum, lo, hi, sigma+0.2 as sigma, (lo-predicted)/(sigma+0.2) as zl, (hi-predicted)/(sigma+0.2) as zh from (select *, case when fold=0 then null when fold=1 then observed-0.2 else observed end as lo, case when fold=2 then null when fold=1 then observed+0.2 else observed end as hi from @predictions))) group by 1
""")
def censored_likelihood(t):
    o = F.col("observed")
    d = t.predictions.withColumns(
        {
            "lo": F.when(F.col("fold") == 0, None).when(F.col("fold") == 1, o - 0.2).otherwise(o),
            "hi": F.when(F.col("fold") == 2, None).when(F.col("fold") == 1, o + 0.2).otherwise(o),
            "sigma": F.col("sigma") + 0.2,
        }
    )
    g = d.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.avg(M.censored_nll("predicted", "sigma", "lo", "hi")).alias("mean_nll"))
    return rounded(g, 5)


@query("conformal_radius", """
select stratum, max(n) as n, round(max(case when rk=pos+1 then ae end),6) as radius from (select stratum, ae, row_number() over (partition by stratum order by ae) as rk, count(*) over (partition by stratum) as n from @err),
 lateral (select ceil(least(1.0,ceil((n+1)*0.9-1e-9)/n)*(n-1)-1e-9) as pos) group by 1
""")
def conformal_radius(t):
    return rounded(M.conformal_radius(errors(t), "e", 0.9, ["stratum"]))


@query("cross_conformal_coverage", """
with r as (select f.fold, max(case when rk=ceil(least(1.0,ceil((n+1)*0.9-1e-9)/n)*(n-1)-1e-9)+1 then ae end) as radius from (select f.fold, e.ae, row_number() over (partition by f.fold order by ae) as rk, count(*) over (partition by f.fold) as n from (select distinct fold from @err) f join @err e on e.fold<>f.fold) f group by 1)
select e.fold, count(*) as n, round(max(radius),6) as radius, round(avg((ae<=radius)::int),6) as coverage from @err e join r on r.fold=e.fold group by 1
""")
def cross_conformal_coverage(t):
    return rounded(M.cross_conformal(errors(t), "e", "fold", 5, 0.9))


@query("best_threshold", """
with d as (select score as s, count(*) as k, sum(label) as ky from @scores group by 1), r as (select s, sum(k) over (order by s)-k as nb, sum(ky) over (order by s)-ky as yb, sum(k) over () as n, sum(ky) over () as y from d)
select s as threshold, round(((y-yb)/y+(nb-yb)/(n-y))/2,12) as balanced_accuracy from r order by 2 desc, round(abs(s-0.5),12), s limit 1
""")
def best_threshold(t):
    return M.best_threshold(t.scores, "label", "score")


@query("stress_strata", """
with x as (select e, grp, unnest(list_filter([case when predicted>=4.7 then 'high_prediction' end, case when sigma<0.08 then 'narrow' end, case when stratum='A' then 'source_a' end, case when observed<3.3 then 'low_tail' end], lambda v: v is not null)) as stratum from @err)
select stratum, count(*) as n_rows, count(distinct grp) as n_groups, round(avg(abs(e)),6) as mae, round(sqrt(avg(e*e)),6) as rmse from x group by 1 having count(*)>=50 and count(distinct grp)>=3
""")
def stress_strata(t):
    s = {
        "high_prediction": F.col("predicted") >= 4.7,
        "narrow": F.col("sigma") < 0.08,
        "source_a": F.col("stratum") == "A",
        "low_tail": F.col("observed") < 3.3,
    }
    return rounded(M.strata_metrics(errors(t), "e", "grp", s, min_rows=50, min_groups=3))


@query("fold_stability", """
select count(*) as folds_observed, count_if(d>0) as positive_folds, count_if(d<0) as negative_folds, count(*)=5 and greatest(count_if(d>0),count_if(d<0))>=4 as direction_stable,
 case when count_if(d>0)>=4 then 'beneficial' when count_if(d<0)>=4 then 'harmful' else 'unstable' end as direction from (select fold, avg(be-ae) as d from @err group by 1)
""")
def fold_stability(t):
    return M.fold_stability(errors(t).withColumn("delta", F.col("be") - F.col("ae")), "fold", "delta")


@query("promotion_decision", """
select stratum, round(avg(ae),6) as candidate_mae, round(avg(be),6) as baseline_mae, round(avg((ae<=1.645*sigma)::int),6) as coverage, avg(ae)<=avg(be)+0.02 as non_inferior, abs(avg((ae<=1.645*sigma)::int)-0.9)<=0.4 as calibrated,
 case when avg(ae)<=avg(be)+0.02 and abs(avg((ae<=1.645*sigma)::int)-0.9)<=0.4 then 'promote' else 'hold' end as decision from @err group by 1
""")
def promotion_decision(t):
    g = errors(t).groupBy("stratum").agg(
        F.avg("ae").alias("candidate_mae"),
        F.avg("be").alias("baseline_mae"),
        F.avg((F.col("ae") <= 1.645 * F.col("sigma")).cast("double")).alias("coverage"),
    )
    ok, cal = F.col("candidate_mae") <= F.col("baseline_mae") + 0.02, F.abs(F.col("coverage") - 0.9) <= 0.4
    return rounded(g.withColumns({"non_inferior": ok, "calibrated": cal, "decision": F.when(ok & cal, "promote").otherwise("hold")}))


@query("release_gate", """
select row_id, sigma<=0.1 and abs(predicted-baseline)<=0.2 as released from @predictions
""")
def release_gate(t):
    return t.predictions.select("row_id", ((F.col("sigma") <= 0.1) & (F.abs(F.col("predicted") - F.col("baseline")) <= 0.2)).alias("released"))


@query("model_disagreement_rank", """
select row_id, round(d,6) as disagreement, rk from (select row_id, abs(predicted-baseline) as d, row_number() over (order by round(abs(predicted-baseline),9) desc, row_id) as rk from @predictions) where rk<=500
""")
def model_disagreement_rank(t):
    d = t.predictions.select("row_id", F.round(F.abs(F.col("predicted") - F.col("baseline")), 9).alias("disagreement"))
    r = R.total_order(d, "disagreement", "row_id", "rk").where("rk <= 500")
    return r.select("row_id", F.round("disagreement", 6).alias("disagreement"), "rk")


@query("residual_correlations", """
with c as (select stratum, count(*) as n, corr(e, sigma) as r from @err group by 1), z as (select *, abs(r)*sqrt(n-3.0) as z from c)
select stratum, n, round(r,6) as r, round(z,6) as z from z
""")
def residual_correlations(t):
    g = errors(t).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.corr("e", "sigma").alias("r"))
    return rounded(g.withColumn("z", F.abs("r") * F.sqrt(F.col("n") - 3.0)))


@query("percentile_rank", """
select p_partkey, round((rank() over (order by p_size)+(count(*) over (partition by p_size)-1)/2.0)/count(*) over (),6) as pct from part
""")
def percentile_rank(t):
    n = R.ranked_values(t.part, "p_size").select(F.col("p_size").alias("v"), (R.average_rank() / F.col("n_group")).alias("pct"))
    return t.part.join(n, F.col("p_size").cast("double") == F.col("v")).select("p_partkey", *rnd("pct"))


@query("equal_count_bins", """
select p_partkey, greatest(1,ceil((row_number() over (order by p_size, p_partkey)-1)*5.0/(count(*) over ()-1)))::int as bin from part
""")
def equal_count_bins(t):
    return R.equal_count_bins(t.part, "p_size", "p_partkey", 5, "bin").select("p_partkey", "bin")


@query("value_quantile_bins", """
with q as (select quantile_cont(p_size,[0.25,0.5,0.75]) as q from part) select p_partkey, (1+(p_size>q[1])::int+(p_size>q[2])::int+(p_size>q[3])::int)::int as bin from part, q
""")
def value_quantile_bins(t):
    q = R.group_quantiles(t.part, "p_size", {"a": 0.25, "b": 0.5, "c": 0.75}).first()
    b = F.lit(1)
    for e in sorted({q.a, q.b, q.c}):
        b = b + F.when(F.col("p_size") > e, 1).otherwise(0)
    return t.part.select("p_partkey", b.cast("int").alias("bin"))


@query("false_discovery_rates", """
with p as (select o_orderpriority as family, o_orderkey, (('0x'||substr(md5('p:'||o_orderkey),1,8))::bigint%997)/997.0::double as p from orders), r as (select *, rank() over (partition by family order by p)+count(*) over (partition by family,p)-1 as rk, count(*) over (partition by family) as m from p)
select family, o_orderkey, round(p,6) as p, round(least(1.0,min(p*m/rk) over (partition by family order by p desc)),6) as q from r
""")
def false_discovery_rates(t):
    from proofmill.functions.draws import hash_int

    d = t.orders.select(
        F.col("o_orderpriority").alias("family"), "o_orderkey", (hash_int(F.lit("p"), F.col("o_orderkey")) % 997 / F.lit(997.0)).alias("p")
    )
    return R.benjamini_hochberg(d, "p", "q", ["family"]).select("family", "o_orderkey", *rnd("p", "q"))


@query("top_failures", """
select row_id, round(ae,4) as ae from @err order by round(ae,4) desc, row_id limit 100
""")
def top_failures(t):
    d = errors(t).select("row_id", F.round("ae", 4).alias("ae"))
    return d.orderBy(F.desc("ae"), "row_id").limit(100)


@query("retained_candidates", """
select p_partkey, p_type from (select *, row_number() over (order by p_retailprice desc, p_partkey) as g, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as f from part) where g<=500 or f=1
""")
def retained_candidates(t):
    """Best rows overall, keeping at least the best of each family."""
    r = R.total_order(t.part, "p_retailprice", "p_partkey", "g")
    best = t.part.groupBy("p_type").agg(F.min_by("p_partkey", F.struct(F.negate("p_retailprice"), F.col("p_partkey"))).alias("b"))
    return r.join(best.select(F.col("b").alias("p_partkey"), F.lit(True).alias("top")), "p_partkey", "left").where(
        (F.col("g") <= 500) | F.col("top")
    ).select("p_partkey", "p_type")


@query("hash_ranked_sample", """
select band, p_partkey from (select *, row_number() over (partition by band order by sha256('7:'||p_partkey), p_partkey) as rn from (select p_partkey, greatest(1,ceil((row_number() over (order by p_retailprice, p_partkey)-1)*10.0/(count(*) over ()-1)))::int as band from part)) where rn<=20
""")
def hash_ranked_sample(t):
    from pyspark.sql import Window

    b = R.equal_count_bins(t.part, "p_retailprice", "p_partkey", 10, "band")
    h = F.sha2(F.concat(F.lit("7:"), F.col("p_partkey").cast("string")), 256)
    rn = F.row_number().over(Window.partitionBy("band").orderBy("h", "p_partkey"))
    return b.withColumn("h", h).withColumn("rn", rn).where("rn <= 20").select("band", "p_partkey")


@query("review_panel", """
with c as (select row_id, ae, case when e>1.2 then 1 when e<-0.6 then 2 when ae>0.9 then 3 else 4 end as cls from @err), b as (select row_id, cls, 0 as tier, ae from (select *, row_number() over (partition by cls order by round(ae,9) desc, row_id) as rn from c) where rn=1),
a as (select row_id, 5 as cls, 1 as tier, ae from c) select row_id, case cls when 1 then 'under' when 2 then 'over' when 3 then 'large' when 4 then 'typical' else 'largest_error' end as reason
from (select *, row_number() over (order by tier, cls, round(ae,9) desc, row_id) as o from (select * from (select *, row_number() over (partition by row_id order by tier, cls) as k from (select * from b union all select * from a)) where k=1)) where o<=40
""")
def review_panel(t):
    from proofmill.operators.selection import reason_panel

    d = errors(t).select("row_id", "e", F.round("ae", 9).alias("ae"))
    classes = {"under": F.col("e") > 1.2, "over": F.col("e") < -0.6, "large": F.col("ae") > 0.9, "typical": F.lit(True)}
    return reason_panel(d, "row_id", "ae", classes, size=40)


@query("group_identity", """
select row_key, coalesce(nullif(trim(a),''),nullif(trim(b),''),'missing:'||row_key) as grp from (select row_key, case when yr%3=0 then '' else subject_id end as a, case when yr%2=0 then ' ' else document_id end as b from @raw)
""")
def group_identity(t):
    d = t.raw.withColumns({"a": F.when(F.col("yr") % 3 == 0, "").otherwise(F.col("subject_id")), "b": F.when(F.col("yr") % 2 == 0, " ").otherwise(F.col("document_id"))})
    return d.select("row_key", P.resolve_group(["a", "b"], "row_key").alias("grp"))


@query("group_holdout", """
with g as (select grp, count(*) as n, sum((stratum='A')::int) as s from @predictions group by 1), c as (select c.c as candidate, g.*, ('0x'||substr(md5('13:'||c.c||':'||grp),1,8))::bigint/4294967296.0::double<0.2 as test from g, range(1,25) c(c)),
 t as (select candidate, sum(n) as n, sum(s) as s, coalesce(sum(case when test then n end),0) as nt, sum(case when test then s end) as st from c group by 1), b as (select candidate from t where nt>0 and nt<n order by round(abs(nt/n-0.2)+0.35*abs(st/nt-s/n),12), candidate limit 1)
select c.test, case when c.test then 'test' else 'train' end as role, sum(n)::bigint as n_rows, count(*) as n_groups from c join b on b.candidate=c.candidate group by 1,2
""")
def group_holdout(t):
    d = t.predictions.withColumn("y", (F.col("stratum") == "A").cast("int"))
    h = P.group_holdout(d, "grp", "y", test_size=0.2, candidates=24, seed=13)
    per = h.groupBy("role", "grp").agg(F.count(F.lit(1)).alias("c"))
    g = per.groupBy("role").agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))
    return g.withColumn("test", F.col("role") == "test")


@query("temporal_holdout", """
with g as (select l_orderkey, min(year(l_shipdate)*12+month(l_shipdate))::bigint as d, count(*) as n from lineitem group by 1), y as (select d, sum(n) as n from g group by 1), c as (select d, sum(n) over (order by d desc) as nt, sum(n) over () as n, min(d) over () as f from y),
 b as (select d from c where d>f and nt>=greatest(2,ceil(n*0.1)) and n-nt>=2 order by round(abs(nt/n-0.2),12), d desc limit 1)
select case when g.d>=b.d then 'test' else 'train' end as role, sum(g.n)::bigint as n_rows, count(*) as n_groups from g, b group by 1
""")
def temporal_holdout(t):
    d = t.lineitem.select("l_orderkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("month"))
    h = P.temporal_holdout(d, "l_orderkey", "month", test_size=0.2)
    per = h.groupBy("role", "l_orderkey").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("role").agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))


@query("temporal_cutoffs", """
with g as (select l_orderkey, min(year(l_shipdate)) as y, count(*) as n from lineitem group by 1), y as (select y, sum(n) as n from g group by 1), c as (select y, sum(n) over (order by y desc) as nt, sum(n) over () as n, min(y) over () as f from y)
select y::int as cutoff, nt::bigint as n_test, n::bigint as n, round(abs(nt/n-0.2),9) as score from c where y>f and nt>=greatest(2,ceil(n*0.1)) and n-nt>=2
""")
def temporal_cutoffs(t):
    d = t.lineitem.select("l_orderkey", F.year("l_shipdate").alias("y"))
    return rounded(P.temporal_cutoffs(d, "l_orderkey", "y"), 9)


@query("split_audit", """
select count_if(l_suppkey%5<>0) as n_train, count_if(l_suppkey%5=0) as n_test, count(distinct case when l_suppkey%5<>0 then l_partkey end) as train_groups, count(distinct case when l_suppkey%5=0 then l_partkey end) as test_groups,
 (select count(*) from (select l_partkey from lineitem group by 1 having count_if(l_suppkey%5=0)>0 and count_if(l_suppkey%5<>0)>0)) as overlapping_groups from lineitem
""")
def split_audit(t):
    d = t.lineitem.select("l_partkey", F.when(F.col("l_suppkey") % 5 == 0, "test").otherwise("train").alias("role"))
    return P.split_audit(d, "l_partkey")


@query("split_digest", """
select n_rows, sha256(n_rows||':'||s0||':'||s1||':'||s2||':'||s3) as digest from (select count(*) as n_rows, sum(('0x'||substr(h,1,8))::bigint) as s0, sum(('0x'||substr(h,9,8))::bigint) as s1, sum(('0x'||substr(h,17,8))::bigint) as s2, sum(('0x'||substr(h,25,8))::bigint) as s3
 from (select sha256(l_orderkey||chr(0)||l_partkey||chr(0)||l_returnflag) as h from lineitem))
""")
def split_digest(t):
    return P.table_digest(t.lineitem, ["l_orderkey", "l_partkey", "l_returnflag"])


@query("group_folds", """
select l_partkey, n, (case when (rk-1)%10<5 then (rk-1)%10 else 9-(rk-1)%10 end)::int as fold from (select *, row_number() over (order by n desc, l_partkey) as rk from (select l_partkey, count(*) as n from lineitem group by 1))
""")
def group_folds(t):
    return P.group_folds(t.lineitem.select("l_partkey"), "l_partkey", 5)


@query("time_folds", """
with g as (select l_partkey, min(year(l_shipdate)) as y from lineitem group by 1), r as (select l_partkey, row_number() over (order by y, l_partkey) as p, count(*) over () as n from g), s as (select *, n//4 as z, n-(n//4)*3 as h from r)
select l_partkey, (case when p<=h then 0 else (p-h-1)//z+1 end)::int as block from s
""")
def time_folds(t):
    d = t.lineitem.select("l_partkey", F.year("l_shipdate").alias("y"))
    return P.time_folds(d, "l_partkey", "y", 3)


@query("learning_subsets", """
select fraction::double as fraction, r::int as repeat, count(*) as n_rows, count(distinct grp) as n_groups from @predictions, (values (0.25),(0.5),(1.0)) f(fraction), range(2) r(r) where ('0x'||substr(md5('5:'||r||':'||grp),1,8))::bigint/4294967296.0::double<fraction group by 1,2
""")
def learning_subsets(t):
    d = P.learning_subsets(t.predictions.select("grp"), "grp", (0.25, 0.5, 1.0), 2, 5)
    per = d.groupBy("fraction", "repeat", "grp").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("fraction", "repeat").agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))


@query("leave_group_out_mean", """
select row_id, round((t.s-g.s)/(t.n-g.n),6) as group_out_mean from @predictions p join (select grp, sum(observed) as s, count(*) as n from @predictions group by 1) g on g.grp=p.grp, (select sum(observed) as s, count(*) as n from @predictions) t
""")
def leave_group_out_mean(t):
    return S.leave_group_out_mean(t.predictions, "grp", "observed").select("row_id", *rnd("group_out_mean"))


@query("balance_weights", """
select row_id, round(t.n/(t.k*c.c)::double,6) as weight from @predictions p join (select stratum, fold, count(*) as c from @predictions group by 1,2) c on c.stratum=p.stratum and c.fold=p.fold, (select count(*) as n, count(distinct (stratum,fold)) as k from @predictions) t
""")
def balance_weights(t):
    return P.balanced_weights(t.predictions, ["stratum", "fold"]).select("row_id", *rnd("weight"))


@query("regime_pool", """
select origin, count(*) as n, count(distinct subject) as n_subjects from (select 'internal' as origin, * from @predictions where stratum='A' and sigma<0.06 union all select 'external', p.* from @predictions p where stratum='N' and subject not in (select subject from @predictions where stratum='A' and sigma<0.06)) where grp not in (select grp from @predictions where subject='S5') group by 1
""")
def regime_pool(t):
    p = t.predictions
    pool = P.regime_pool(
        p.where("stratum = 'A' and sigma < 0.06"), p.where("stratum = 'N'"), "subject", p.where("subject = 'S5'"), "grp"
    )
    per = pool.groupBy("origin", "subject").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("origin").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_subjects"))


@query("regime_pools", """
with i as (select * from @predictions where stratum='A' and sigma<0.07), x as (select * from @predictions where stratum='A' and sigma>=0.1), e as (select * from @predictions where stratum='N' and subject not in (select subject from i)), tg as (select distinct grp from @predictions where subject in ('S5','S6')),
u as (select 'internal' as origin, false as big, * from i union all select 'extension', false, * from x union all select 'external', observed>=4.6, * from e),
p as (select r.regime, u.* from u join (values ('internal_only','internal'),('plus_extension','internal'),('plus_extension','extension'),('plus_external_naive','internal'),('plus_external_naive','external'),('plus_external_balanced','internal'),('plus_external_balanced','external'),('plus_external_large','internal'),('plus_external_large','external'),
 ('plus_extension_and_external_balanced','internal'),('plus_extension_and_external_balanced','extension'),('plus_extension_and_external_balanced','external')) r(regime, origin) using (origin) where grp not in (select grp from tg) and (r.regime<>'plus_external_large' or origin='internal' or big)),
t as (select regime, count(*) as n, count_if(origin<>'external') as a from p group by 1)
select regime, origin, count(*) as n, round(avg(case when regime like '%balanced' or regime like '%large' then case when a=t.n then 1.0 when origin<>'external' then t.n/(2.0*a) else t.n/(2.0*(t.n-a)) end else 1.0 end),9) as weight from p join t using (regime) group by 1,2
""")
def regime_pools(t):
    p = t.predictions
    pools = P.regime_pools(p.where("stratum = 'A' and sigma < 0.07"), p.where("stratum = 'A' and sigma >= 0.1"), p.where("stratum = 'N'"), "subject", "grp", p.where("subject in ('S5', 'S6')"), F.col("observed") >= 4.6)
    return rounded(pools.groupBy("regime", "origin").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("weight")), 9)


def boot_sql(seed: int, reps: int) -> str:
    return f"dr as (select r.r as rep, grp, {poisson_sql(seed, 'r.r', 'grp')} as weight from (select distinct grp from @predictions), range(1,{reps + 1}) r(r))"


@query("group_bootstrap_metrics", f"""
with {boot_sql(11, 200)}, g as (select grp, count(*) as n, sum(ae) as a, sum(e*e) as s from @err group by 1), b as (select rep, sum(weight*a)/sum(weight*n) as mae, sqrt(sum(weight*s)/sum(weight*n)) as rmse from dr join g using(grp) where weight>0 group by 1)
select 'mae' as metric, round(quantile_cont(mae,0.025),6) as lower, round(quantile_cont(mae,0.975),6) as upper, count(*) as n_replicates from b union all select 'rmse', round(quantile_cont(rmse,0.025),6), round(quantile_cont(rmse,0.975),6), count(*) from b
""")
def group_bootstrap_metrics(t):
    reps = S.group_bootstrap(
        errors(t),
        "grp",
        {"n": F.count(F.lit(1)), "a": F.sum("ae"), "s": F.sum(F.col("e") * F.col("e"))},
        {"mae": F.col("a") / F.col("n"), "rmse": F.sqrt(F.col("s") / F.col("n"))},
        replicates=200,
        seed=11,
    )
    return rounded(S.percentile_interval(reps, ["mae", "rmse"]))


@query("paired_group_bootstrap", f"""
with {boot_sql(3, 200)}, g as (select grp, count(*) as n, sum(be-ae) as s from @err group by 1), b as (select rep, sum(weight*s)/sum(weight*n) as b from dr join g using(grp) where weight>0 group by 1),
f as (select r.r as rep, abs(sum(case when ('0x'||substr(md5('flip3:'||r.r||':'||grp),1,8))::bigint%2=0 then s else -s end)) as f, abs(sum(s)) as o from g, range(1,201) r(r) group by 1)
select round((select sum(s)/sum(n) from g),6) as effect, (select sum(n)::bigint from g) as n_rows, (select count(*) from g) as n_groups, round(quantile_cont(b,0.025),6) as lower, round(quantile_cont(b,0.975),6) as upper, round(avg((b>0)::int),6) as probability_positive,
 (select round((count_if(f>=o-1e-9)+1)/(count(*)+1),6) from f) as sign_flip_p from b
""")
def paired_group_bootstrap(t):
    d = errors(t).withColumn("delta", F.col("be") - F.col("ae"))
    return rounded(S.paired_bootstrap(d, "grp", "delta", replicates=200, seed=3))


@query("permutation_correlation", """
with m as (select p_partkey, p_brand, p_size-avg(p_size) over (partition by p_brand) as x, p_retailprice-avg(p_retailprice) over (partition by p_brand) as y from part), h as (select *, row_number() over (partition by p_brand order by md5('home9:'||p_partkey), p_partkey) as pos from m),
p as (select r.r as rep, p_brand, y, row_number() over (partition by p_brand, r.r order by md5('9:'||r.r||':'||p_partkey), p_partkey) as pos from m, range(1,31) r(r)), n as (select rep, corr(h.x, p.y) as r from p join h on h.p_brand=p.p_brand and h.pos=p.pos group by 1), o as (select corr(x,y) as o, count(*) as n from m)
select round(o,6) as observed, any_value(o.n) as n, round((count_if(abs(r)>=abs(o)-1e-12)+1)/(count(*)+1),6) as p_value from n, o group by o
""")
def permutation_correlation(t):
    return rounded(S.permutation_correlation(t.part, "p_partkey", "p_size", "p_retailprice", within=["p_brand"], replicates=30, seed=9))


@query("conditional_strata", """
with q as (select quantile_cont(l_quantity,[0.25,0.5,0.75]) as a, quantile_cont(l_discount,[0.25,0.5,0.75]) as b from lineitem where l_orderkey%5<>0)
select cell, count(*) as n from (select (l_quantity>=a[1])::int+(l_quantity>=a[2])::int+(l_quantity>=a[3])::int||'_'||((l_discount>=b[1])::int+(l_discount>=b[2])::int+(l_discount>=b[3])::int) as cell from lineitem, q) group by 1
""")
def conditional_strata(t):
    from proofmill.operators.selection import quantile_cells

    tr = t.lineitem.where(F.col("l_orderkey") % 5 != 0)
    d = quantile_cells(t.lineitem, tr, ["l_quantity", "l_discount"], (0.25, 0.5, 0.75), "cell")
    return d.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query("label_permutation_null", """
with h as (select doc_id, score, label, row_number() over (order by md5('home4:'||doc_id), doc_id) as pos from @scores), p as (select r.r as rep, label, row_number() over (partition by r.r order by md5('4:'||r.r||':'||doc_id), doc_id) as pos from @scores, range(1,41) r(r))
select p.rep::int as rep, round(corr(h.score, p.label),6) as r from p join h on h.pos=p.pos group by 1
""")
def label_permutation_null(t):
    p = S.permuted(t.scores, "doc_id", "label", replicates=40, seed=4, carry=("score",))
    return rounded(p.groupBy("rep").agg(F.corr("score", "permuted_label").alias("r")))


@query("coarsened_match", """
with b as (select row_id, stratum, ae, floor(observed*2) as c1, floor(sigma*20) as c2 from @err), k as (select c1,c2 from b group by 1,2 having count(distinct stratum)>=2) select stratum, count(*) as n, round(avg(ae),6) as mae from b join k using(c1,c2) group by 1
""")
def coarsened_match(t):
    from proofmill.operators.joins import matched_cells

    d = errors(t).withColumns({"c1": F.floor(F.col("observed") * 2), "c2": F.floor(F.col("sigma") * 20)})
    m = matched_cells(d, ["c1", "c2"], "stratum", 2)
    return rounded(m.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.avg("ae").alias("mae")))
