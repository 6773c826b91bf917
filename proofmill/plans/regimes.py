"""Queries for hinges and the gate over outcomes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from proofmill.operators import regimes as RG
from proofmill.plans.measurements import rnd
from proofmill.plans.registry import query

CUTS = (10.0, 20.0, 30.0, 40.0)


def poisson_sql(seed, rep: str, group: str) -> str:
    """A Poisson(1) number from the hash of seed, replicate and group."""
    below, chance, out = 0.0, math.exp(-1), []
    for k in range(1, 13):
        below += chance
        chance /= k
        out.append(f"(u>={below!r}::double)::int")
    return f"(select {'+'.join(out)} from (select ('0x'||substr(md5('{seed}:'||{rep}||':'||{group}),1,8))::bigint/4294967296.0::double as u))"


def _scan_sql(name: str, y: str, reps: int, seed: int, minimum: int) -> str:
    """CTEs up to ``name``_s with one row for each replicate and cut: sums of products, columns swept out one after another."""
    z = ["1.0::double", "u", "c", "u*c", f"({y})::double"]
    moments = ", ".join(f"sum({z[i]}*{z[j]}) as m{i}{j}" for i in range(5) for j in range(i, 5))
    drawn = ", ".join(f"sum(weight*m{i}{j}) as m{i}{j}" for i in range(5) for j in range(i, 5))
    weights = f"select 0 as rep, grp, 1 as weight from (select distinct grp from {name}_g)"
    if reps:
        weights += f" union all select r.r, grp, {poisson_sql(seed, 'r.r', 'grp')} from (select distinct grp from {name}_g), range(1,{reps + 1}) r(r)"
    upper = ", ".join(f"sum(m{i}{j}) filter (bin>=k) as s{i}{j}, sum(m{i}{j}) as t{i}{j}" for i in range(5) for j in range(i, 5))
    at = lambda p, i, j: f"{p}{min(i, j)}{max(i, j)}"
    # columns 0-3 of the line, 4 the hinge, 5 the outcome
    cell = {}
    for i in range(6):
        for j in range(6):
            a, b = (v if v < 4 else v - 1 for v in (i, j))
            if 4 not in (i, j):
                cell[i, j] = at("t", a, b)
            elif i == j:
                cell[i, j] = "s11-2*tau*s01+tau*tau*s00"
            else:
                o = b if i == 4 else a
                cell[i, j] = f"{at('s', 1, o)}-tau*{at('s', 0, o)}"
    long = ", ".join(f"{{'i':{i},'j':{j},'v':({v})::double}}" for (i, j), v in cell.items())
    steps = [
        f"{name}_x as (select 'G'||l_suppkey as grp, l_quantity::double as x, (l_quantity-m)/s as u, coalesce(case when l_tax>0 then l_discount end::double, q) as c, l_extendedprice, l_tax, l_linenumber, l_discount from lineitem, (select avg(l_quantity) as m, stddev_pop(l_quantity) as s, quantile_cont(case when l_tax>0 then l_discount end::double, 0.5) as q from lineitem))",
        f"{name}_g as (select grp, {'+'.join(f'(x>={c})::int' for c in CUTS)} as bin, {moments} from {name}_x group by 1,2)",
        f"{name}_w as ({weights})",
        f"{name}_b as (select rep, bin, {drawn} from {name}_g join {name}_w using (grp) where weight>0 group by 1,2)",
        f"{name}_u as (select rep, k, cut, (cut-m)/s as tau, {upper} from {name}_b, (values {', '.join(f'({i},{c}::double)' for i, c in enumerate(CUTS, 1))}) v(k, cut), (select avg(l_quantity) as m, stddev_pop(l_quantity) as s from lineitem) group by 1,2,3,4)",
        f"{name}_0 as materialized (select rep, cut, unnest([{long}], recursive:=true) from {name}_u where t00-s00>={minimum} and s00>={minimum})",
    ]
    for k in range(5):
        was = f"{name}_{k}"
        steps.append(f"{name}_{k + 1} as materialized (select a.rep, a.cut, a.i, a.j, a.v-r.v*c.v/p.v as v from {was} a join {was} r on r.rep=a.rep and r.cut=a.cut and r.i=a.i and r.j={k} join {was} c on c.rep=a.rep and c.cut=a.cut and c.i={k} and c.j=a.j join {was} p on p.rep=a.rep and p.cut=a.cut and p.i={k} and p.j={k} where a.i>{k} and a.j>{k})")
    steps.append(
        f"{name}_s as (select u.rep, u.cut, t00 as n, t00-s00 as n_left, s00 as n_right, r.v as rss, t00*ln(r.v/t00)+5*ln(t00) as bic, t00*ln(b.v/t00)+4*ln(t00) as baseline_bic, h.v/p.v as effect from {name}_u u join {name}_5 r on r.rep=u.rep and r.cut=u.cut join {name}_4 b on b.rep=u.rep and b.cut=u.cut and b.i=5 and b.j=5"
        f" join {name}_4 h on h.rep=u.rep and h.cut=u.cut and h.i=4 and h.j=5 join {name}_4 p on p.rep=u.rep and p.cut=u.cut and p.i=4 and p.j=4)"
    )
    return ",\n".join(steps)


def _best_sql(name: str) -> str:
    return f"""{name}_l as (select *, min(bic) over (partition by rep) as low, row_number() over (partition by rep order by round(bic,9), cut) as rk from {name}_s),
{name}_p as (select rep, 1/(1+exp(least(700.0,-0.5*(any_value(baseline_bic)-any_value(low))))/avg(exp(-0.5*(bic-low)))) as probability from {name}_l group by 1),
{name}_h as (select rep, cut, n_left, n_right, effect, probability, baseline_bic-bic>=2.0 and probability>=0.5 as selected from {name}_l join {name}_p using (rep) where rk=1)"""


OUTCOME_SQL = {"price": "greatest(l_extendedprice/1000.0, 30)", "bent": "abs(x-22)+l_tax*9", "flat": "l_linenumber+l_tax"}


def _outcomes():
    x = F.col("l_quantity").cast("double")
    return {"price": F.greatest(F.col("l_extendedprice") / 1000.0, F.lit(30.0)).cast("double"), "bent": F.abs(x - 22) + F.col("l_tax") * 9, "flat": (F.col("l_linenumber") + F.col("l_tax")).cast("double")}


@query("hinge_scan", f"with {_scan_sql('a', OUTCOME_SQL['price'], 0, 0, 15)} select cut, n_left, n_right, round(rss,1) as rss, round(bic,3) as bic, round(baseline_bic-bic,3) as delta_bic, round(effect,5) as effect from a_s")
def hinge_scan(t):
    s = RG.hinge_scan(_rows(t), "x", "price", CUTS, covariates=["c"])
    return s.select("cut", "n_left", "n_right", *rnd("rss", digits=1), *rnd("bic", "delta_bic", digits=3), *rnd("effect", digits=5))


def _rows(t):
    return t.lineitem.select(
        F.concat(F.lit("G"), "l_suppkey").alias("grp"), F.col("l_quantity").cast("double").alias("x"), F.when(F.col("l_tax") > 0, F.col("l_discount").cast("double")).alias("c"), *[e.alias(n) for n, e in _outcomes().items()]
    )


REPLICATES = 30


@query("change_point_bootstrap", f"with {_scan_sql('a', OUTCOME_SQL['price'], REPLICATES, 21, 15)},{_best_sql('a')} select rep, cut, round(effect,4) as effect, round(probability,5) as probability, selected from a_h")
def change_point_bootstrap(t):
    s = RG.hinge_scan(_rows(t), "x", "price", CUTS, covariates=["c"], group="grp", replicates=REPLICATES, seed=21)
    return RG.best_hinge(s).select("rep", "cut", *rnd("effect", digits=4), *rnd("probability", digits=5), "selected")


def _summary_sql(name: str, outcome: str) -> str:
    return f"""select '{outcome}' as outcome, o.cut, o.n_left, o.n_right, o.effect, o.probability, o.selected, count(r.rep)/{REPLICATES}.0::double as selection_frequency, quantile_cont(r.cut,0.025) as low, quantile_cont(r.cut,0.975) as high, coalesce(avg((sign(r.effect)=sign(o.effect))::int::double),0.0) as direction_stability
 from {name}_h o left join {name}_h r on r.rep>0 and r.selected where o.rep=0 group by all"""


ADJACENT = [("price", "bent"), ("bent", "flat")]


@query("outcome_gate", f"""
with {", ".join(_scan_sql(n, OUTCOME_SQL[o], REPLICATES, 21, 15) + "," + _best_sql(n) for n, o in zip("abc", OUTCOME_SQL))},
s as ({" union all ".join(_summary_sql(n, o) for n, o in zip("abc", OUTCOME_SQL))}),
f as (select *, high-low as width, concat_ws(';', case when not selected then 'no segmented evidence' end, case when selection_frequency<0.7 then 'selected too seldom' end, case when high-low is null or high-low>15 then 'location too wide' end, case when direction_stability<0.7 then 'direction unstable' end, case when least(n_left,n_right)<15 then 'too few rows on one side' end) as failures from s),
j(outcome, other) as (values {", ".join(f"('{a}','{b}'),('{b}','{a}')" for a, b in ADJACENT)}),
m as (select f.outcome, string_agg(g.outcome, ';' order by g.outcome) as partners from f join j using (outcome) join f g on g.outcome=j.other where f.failures='' and g.failures='' and greatest(f.low,g.low)<=least(f.high,g.high) group by 1)
select f.outcome, cut, round(selection_frequency,6) as selection_frequency, round(low,6) as low, round(high,6) as high, round(direction_stability,6) as direction_stability, failures, failures='' as passed, coalesce(partners,'') as partners, partners is not null as supported from f left join m using (outcome)
""")
def outcome_gate(t):
    d = _rows(t)
    summaries = None
    for name in OUTCOME_SQL:
        s = RG.hinge_scan(d, "x", name, CUTS, covariates=["c"], group="grp", replicates=REPLICATES, seed=21)
        one = RG.regime_summary(RG.best_hinge(s), name, REPLICATES)
        summaries = one if summaries is None else summaries.unionByName(one)
    g = RG.outcome_gate(summaries, ADJACENT, width=15.0)
    return g.select("outcome", "cut", *rnd("selection_frequency", "low", "high", "direction_stability", digits=6), "failures", "passed", "partners", "supported")
