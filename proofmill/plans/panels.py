"""Queries for constrained panels and quotas with whole pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill.operators import panels as PL
from proofmill.plans.registry import VIEWS, query
from proofmill.plans.relations import TIER, items, prioritized


def _farthest_sql(size: int) -> str:
    """Row 0 first, then one row for each label, then the farthest rows with at most two of a label: each pick a CTE of its own."""
    steps = ["e as materialized (select vec_id, embedding::double[] as x, label from embeddings where embedding is not null)", "p0 as (select vec_id, x, label, 1 as place, 'mandatory' as reason from e where vec_id=0)"]
    far = "round((select min(list_distance(e.x, p.x)) from {0} p), 9) desc, vec_id"
    labels = "(select list_sort(list(distinct label::varchar)) from e where label is not null)"
    for i in range(1, size):
        was = f"p{i - 1}"
        # the next label that nobody has, if any; else a label that is not full, else any
        missing = f"(select min(label::varchar) from e where label is not null and label::varchar not in (select label::varchar from {was} where label is not null))"
        full = f"(select label from {was} where label is not null group by 1 having count(*)>=2)"
        room = f"(select count(*) from e where vec_id not in (select vec_id from {was}) and (label is null or label not in {full}))"
        steps.append(
            f"p{i} as materialized (select * from {was} union all (select vec_id, x, label, {i + 1}, case when {missing} is not null then 'label '||{missing} else 'distance' end from e where vec_id not in (select vec_id from {was})"
            f" and case when {missing} is not null then label::varchar={missing} when {room}>0 then label is null or label not in {full} else true end order by {far.format(was)} limit 1))"
        )
    return "with " + ",\n".join(steps) + f" select vec_id, place::int as place, reason from p{size - 1}"


@query("panel_maximin", _farthest_sql(14))
def panel_maximin(t):
    return PL.constrained_panel(t.embeddings, "vec_id", "embedding", 14, mandatory=[0], strata=["label"], series="label", per_series=2)


VIEWS["pilot"] = "select p_partkey, round(potency-6.5,6) as a, round(quality-0.5,6) as b, violations, series from @items"
PILOT_PAIRS = "select x.p_partkey as id_a, y.p_partkey as id_b, round(sqrt((x.a-y.a)**2+(x.b-y.b)**2),9) as gap from @pilot x join @pilot y on y.p_partkey=x.p_partkey+1 and y.violations=x.violations"


def _information_sql(size: int, pairs: int) -> str:
    steps = ["e as materialized (select * from @pilot)", f"m as materialized ({PILOT_PAIRS})", "q0 as (select null::bigint as id, 0 as n, null::double as gap where false)"]
    for i in range(1, pairs + 1):
        was = f"q{i - 1}"
        steps.append(f"b{i} as materialized (select * from m where id_a not in (select id from {was}) and id_b not in (select id from {was}) order by gap desc, id_a limit 1)")
        steps.append(f"q{i} as (select * from {was} union all select id_a, {2 * i - 1}, gap from b{i} union all select id_b, {2 * i}, gap from b{i})")
    steps.append(f"p{2 * pairs} as materialized (select e.*, q.n as place, 'pair '||((q.n+1)//2) as reason from q{pairs} q join e on e.p_partkey=q.id)")
    for i in range(2 * pairs, size):
        was = f"p{i}"
        missing = f"(select min(violations::varchar) from e where violations::varchar not in (select violations::varchar from {was}))"
        far = f"(select min(sqrt((e.a-p.a)**2+(e.b-p.b)**2)) from {was} p)"
        s = f"(select 1+sum(a*a) as aa, sum(a*b) as ab, 1+sum(b*b) as bb from {was})"
        gain = "ln(1+(e.a*e.a*s.bb-2*e.a*e.b*s.ab+e.b*e.b*s.aa)/(s.aa*s.bb-s.ab*s.ab))"
        full = f"(select series from {was} group by 1 having count(*)>=2)"
        room = f"(select count(*) from e where p_partkey not in (select p_partkey from {was}) and series not in {full})"
        steps.append(
            f"p{i + 1} as materialized (select * from {was} union all (select e.*, {i + 1}, case when {missing} is not null then 'violations '||{missing} else 'information' end from e, {s} s where p_partkey not in (select p_partkey from {was})"
            f" and case when {missing} is not null then violations::varchar={missing} when {room}>0 then series not in {full} else true end order by round(case when {missing} is not null then {far} else {gain} end, 9) desc, p_partkey limit 1))"
        )
    return "with " + ",\n".join(steps) + f" select p_partkey, place::int as place, reason from p{size}"


@query("pilot_information", _information_sql(12, 2))
def pilot_information(t):
    d = items(t).select("p_partkey", F.round(F.col("potency") - 6.5, 6).alias("a"), F.round(F.col("quality") - 0.5, 6).alias("b"), "violations", "series")
    x, y = d.alias("x"), d.alias("y")
    gap = F.round(F.sqrt(F.pow(F.col("x.a") - F.col("y.a"), 2) + F.pow(F.col("x.b") - F.col("y.b"), 2)), 9)
    pairs = x.join(y, (F.col("y.p_partkey") == F.col("x.p_partkey") + 1) & (F.col("x.violations") == F.col("y.violations")))
    pairs = pairs.select(F.col("x.p_partkey").alias("id_a"), F.col("y.p_partkey").alias("id_b"), gap.alias("gap"))
    d = d.withColumn("vec", F.array("a", "b"))
    return PL.constrained_panel(d, "p_partkey", "vec", 12, goal="information", pairs=pairs, pair_order=[F.negate("gap"), F.col("id_a")], pair_slots=4, strata=["violations"], series="series", per_series=2)


def _mixed_sql(pairs: int) -> str:
    left = lambda was, column: f"(3-(select count(*) from {was} u where u.series={column}))"
    steps = [
        f"p as materialized (select *, {TIER} as tier, round(score_without_safety,9) as s from @prior)",
        "c0 as materialized (select p_partkey, series, 'safety_gap' as category, row_number() over (order by s desc, p_partkey) as place, null as pair from (select * from (select *, row_number() over (partition by series order by s desc, p_partkey) as rn from p where tier='priority_2_safety_gap') where rn<=3 order by s desc, p_partkey limit 8))",
        "m as materialized (select x.p_partkey as id_a, y.p_partkey as id_b, x.series as series_a, y.series as series_b, round(abs(x.potency-y.potency),9) as gap from p x join p y on y.p_partkey=x.p_partkey+7)",
    ]
    for i in range(1, pairs + 1):
        was = f"c{i - 1}"
        steps.append(
            f"b{i} as materialized (select * from m where id_a not in (select p_partkey from {was}) and id_b not in (select p_partkey from {was}) and {left(was, 'series_a')}>=case when series_a=series_b then 2 else 1 end and {left(was, 'series_b')}>=1 order by gap desc, id_a limit 1)"
        )
        steps.append(
            f"c{i} as materialized (select * from {was} union all select id_a, series_a, 'contrast', (select count(*) from {was})+1, 'contrast {i}' from b{i} union all select id_b, series_b, 'contrast', (select count(*) from {was})+2, 'contrast {i}' from b{i})"
        )
    was = f"c{pairs}"
    steps.append(
        f"z as (select p_partkey, 'negative_control' as category, (select count(*) from {was})+row_number() over (order by quality desc, p_partkey) as place, null as pair from (select * from (select *, row_number() over (partition by series order by quality desc, p_partkey) as rn from p where potency<=5 and p_partkey not in (select p_partkey from {was})) where rn<={left(was, 'series')} order by quality desc, p_partkey limit 6))"
    )
    return "with " + ",\n".join(steps) + f" select p_partkey, category, place::int as place, pair::varchar as pair from {was} union all select p_partkey, category, place::int, pair from z"


@query("quota_with_pairs", _mixed_sql(3))
def quota_with_pairs(t):
    """Single rows and whole pairs that compete for the places of a series."""
    d = prioritized(t).withColumn("s", F.round("score_without_safety", 9))
    x, y = d.alias("x"), d.alias("y")
    pairs = x.join(y, F.col("y.p_partkey") == F.col("x.p_partkey") + 7).select(
        F.col("x.p_partkey").alias("id_a"), F.col("y.p_partkey").alias("id_b"), F.col("x.series").alias("series_a"), F.col("y.series").alias("series_b"), F.round(F.abs(F.col("x.potency") - F.col("y.potency")), 9).alias("gap")
    )
    categories = [
        {"name": "safety_gap", "quota": 8, "where": F.col("tier") == "priority_2_safety_gap", "order": [F.desc("s"), F.col("p_partkey")]},
        {"name": "contrast", "quota": 6, "pairs": pairs, "order": [F.negate("gap"), F.col("id_a")]},
        {"name": "negative_control", "quota": 6, "where": F.col("potency") <= 5.0, "order": [F.desc("quality"), F.col("p_partkey")]},
    ]
    return PL.mixed_quotas(d, "p_partkey", "series", categories, per_series=3)
