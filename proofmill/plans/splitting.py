"""Queries for split plans, stratified folds and group baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill.operators import splitplan as SP
from proofmill.plans.aggregates import rounded
from proofmill.plans.regimes import poisson_sql
from proofmill.plans.registry import VIEWS, query

VIEWS["planrows"] = """
select 'S'||l_partkey as subject, 'G'||l_suppkey as grp, (l_returnflag='A')::int as y, (year(l_shipdate)*12+month(l_shipdate))::bigint as month, case when l_suppkey%10=0 and l_linenumber=7 then (year(l_shipdate)*12+month(l_shipdate))::bigint end as seldom from lineitem
"""


def plan_rows(t):
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long")
    return t.lineitem.select(F.concat(F.lit("S"), "l_partkey").alias("subject"), F.concat(F.lit("G"), "l_suppkey").alias("grp"), (F.col("l_returnflag") == "A").cast("int").alias("y"), month.alias("month"), F.when((F.col("l_suppkey") % 10 == 0) & (F.col("l_linenumber") == 7), month).alias("seldom"), F.lit("one").alias("same"))


def _drawn(name: str, unit: str) -> str:
    """CTEs for the best draw of whole units: ``name_r`` has subject, y and role."""
    return f"""
{name}_u as (select subject, {unit} as unit from @planrows group by 1), {name}_g as (select unit, y, count(*) as n from @planrows join {name}_u using (subject) group by 1,2),
{name}_c as (select c as candidate, y, sum(n) as n, sum(case when ('0x'||substr(md5('13:'||c||':'||unit),1,8))::bigint/4294967296.0::double<0.2 then n else 0 end) as nt from {name}_g, range(1,25) r(c) group by 1,2),
{name}_t as (select candidate, sum(n) as n, sum(nt) as nt, sum(n*y) as s, sum(nt*y) as st, count_if(nt=0 or nt=n) as miss from {name}_c group by 1),
{name}_b as (select candidate, round(abs(nt/n-0.2)+case when miss>0 then 10.0 else 0.35*abs(st/nt-s/n) end,12) as score from {name}_t where nt>0 and nt<n order by 2, 1 limit 1),
{name}_r as (select p.subject, y, case when ('0x'||substr(md5('13:'||candidate||':'||unit),1,8))::bigint/4294967296.0::double<0.2 then 'test' else 'train' end as role, score, null::bigint as cutoff from @planrows p join {name}_u using (subject), {name}_b)"""


def _told(requested: str, strategy: str, reason: str, rows: str) -> str:
    return f"""
select '{requested}' as requested, '{strategy}' as strategy, {reason} as fallback_reason, any_value(cutoff)::bigint as cutoff, round(any_value(score),9)::double as score, count(*) as n_rows, count_if(role='train') as n_train, count_if(role='test') as n_test,
 (select count(*) from (select subject from {rows} group by 1 having count(distinct role)>1)) as identity_overlap,
 sha256(count(*)||':'||sum(('0x'||substr(h,1,8))::bigint)||':'||sum(('0x'||substr(h,9,8))::bigint)||':'||sum(('0x'||substr(h,17,8))::bigint)||':'||sum(('0x'||substr(h,25,8))::bigint)) as digest from (select *, sha256(subject||chr(0)||y||chr(0)||role) as h from {rows})"""


SPLIT_SQL = f"""
with {_drawn('a', 'any_value(subject)')},{_drawn('g', 'min(grp)')},
tf as (select subject, min(month) as f from @planrows group by 1), tc as (select f, y, count(*) as n from @planrows join tf using (subject) group by 1,2),
tk as (select k.f as cutoff, y, sum(n) as n, sum(case when tc.f>=k.f then n else 0 end) as nt from (select distinct f from tc where f>(select min(f) from tc)) k, tc group by 1,2),
tt as (select cutoff, sum(n) as n, sum(nt) as nt, count_if(nt=0 or nt=n) as miss from tk group by 1),
tb as (select cutoff, round(abs(nt/n-0.2)+case when miss>0 then 10.0 else 0.0 end,12) as score from tt where nt>=greatest(2,ceil(n*0.1)) and n-nt>=2 order by 2, 1 desc limit 1),
tr as (select p.subject, y, case when f>=cutoff then 'test' else 'train' end as role, score, cutoff from @planrows p join tf using (subject), tb)
{_told('random', 'random', 'null', 'a_r')} union all {_told('group', 'group', 'null', 'g_r')} union all {_told('temporal', 'temporal', 'null', 'tr')}
union all {_told('temporal', 'random', "'too few dated rows'", 'a_r')} union all {_told('group', 'random', "'a group holdout needs two groups'", 'a_r')}
"""


@query("split_plan", SPLIT_SQL)
def split_plan(t):
    """Five plans over one table; the last two cannot be carried out and say why."""
    d = plan_rows(t)
    asked = [("random", {}), ("group", {"group": "grp"}), ("temporal", {"year": "month"}), ("temporal", {"year": "seldom"}), ("group", {"group": "same"})]
    return rounded(SP.record_table(t.spark, [SP.split_plan(d, how, "subject", label="y", **kw)[1] for how, kw in asked]), 9)


@query("stratified_folds", """
with g as (select 'P'||l_partkey as grp, count(*) as n, count_if(l_returnflag='A') as a, count_if(l_returnflag='N') as b, count_if(l_returnflag='R') as c from lineitem group by 1), r as (select count_if(l_returnflag='A') as a, count_if(l_returnflag='N') as b, count_if(l_returnflag='R') as c from lineitem),
o as (select g.*, list_sort([{'n': r.a, 'k': 'A', 'v': g.a}, {'n': r.b, 'k': 'N', 'v': g.b}, {'n': r.c, 'k': 'R', 'v': g.c}]) as l from g, r),
k as (select *, row_number() over (order by l[1].v desc, l[2].v desc, l[3].v desc, lpad(grp,40,' ')) as rk from o)
select grp, n, (case when (rk-1)%10<5 then (rk-1)%10 else 9-(rk-1)%10 end)::int as fold from k
""")
def stratified_folds(t):
    d = t.lineitem.select(F.concat(F.lit("P"), "l_partkey").alias("grp"), "l_returnflag")
    return SP.stratified_folds(d, "grp", "l_returnflag", 5)[0].select("grp", "n", "fold")


VIEWS["lgo"] = """
with b as (select 'G'||l_suppkey as grp, log10(l_extendedprice)::double as y, l_quantity::double as a, l_discount::double as b from lineitem),
g as (select grp, count(*)::double as n, sum(y) as y, sum(a) as a, sum(b) as b, sum(a*a) as aa, sum(a*b) as ab, sum(b*b) as bb, sum(a*y) as ay, sum(b*y) as yb from b group by 1),
t as (select sum(n) as n, sum(y) as y, sum(a) as a, sum(b) as b, sum(aa) as aa, sum(ab) as ab, sum(bb) as bb, sum(ay) as ay, sum(yb) as yb from g),
r as (select grp, t.n-g.n as n, (t.y-g.y)/(t.n-g.n) as my, (t.a-g.a)/(t.n-g.n) as ma, (t.b-g.b)/(t.n-g.n) as mb, (t.aa-g.aa)/(t.n-g.n) as aa, (t.ab-g.ab)/(t.n-g.n) as ab, (t.bb-g.bb)/(t.n-g.n) as bb, (t.ay-g.ay)/(t.n-g.n) as ay, (t.yb-g.yb)/(t.n-g.n) as yb from g, t),
s as (select grp, n, my, ma, mb, sqrt(aa-ma*ma) as sa, sqrt(bb-mb*mb) as sb, ab-ma*mb as cab, ay-ma*my as cay, yb-mb*my as cby from r),
c as (select grp, my, ma, mb, sa, sb, 1+10.0/n as d, cab/(sa*sb) as r, cay/sa as u, cby/sb as v from s),
w as (select grp, my, ma, mb, (d*u-r*v)/(d*d-r*r)/sa as wa, (d*v-r*u)/(d*d-r*r)/sb as wb from c)
select b.grp, b.y, my as train_mean, my+wa*(b.a-ma)+wb*(b.b-mb) as ridge from b join w using (grp)
"""


@query("group_baselines", f"""
with e as (select grp, y, train_mean, 'ridge' as model, ridge as p from @lgo union all select grp, y, train_mean, 'train_mean', train_mean from @lgo),
g as (select model, grp, count(*) as n, sum(abs(y-p)) as ae, sum((y-p)*(y-p)) as se, sum(abs(y-p)-abs(y-train_mean)) as de from e group by 1,2),
w as (select r.rep, grp, {poisson_sql(7, 'r.rep', 'grp')} as weight from (select distinct grp from g), range(1,101) r(rep)),
b as (select model, rep, sum(weight*de)/sum(weight*n) as d from w join g using (grp) where weight>0 group by 1,2),
l as (select model, quantile_cont(d,0.025) as lower, quantile_cont(d,0.975) as upper, avg((d<0)::int::double) as probability_better from b group by 1)
select model, sum(n)::bigint as n_rows, count(*) as n_groups, round(sum(ae)/sum(n),6) as mae, round(sqrt(sum(se)/sum(n)),6) as rmse, round(sum(de)/sum(n),6) as delta_mae, round(any_value(lower),6) as lower, round(any_value(upper),6) as upper, round(any_value(probability_better),6) as probability_better from g join l using (model) group by 1
""")
def group_baselines(t):
    d = t.lineitem.select(F.concat(F.lit("G"), "l_suppkey").alias("grp"), F.log10("l_extendedprice").alias("y"), F.col("l_quantity").cast("double").alias("a"), F.col("l_discount").cast("double").alias("b"))
    scored = SP.leave_group_out_ridge(d, "grp", ["a", "b"], "y", 10.0)
    return rounded(SP.baseline_table(scored, "grp", "y", ["ridge", "train_mean"], "train_mean", replicates=100, seed=7), 6)
