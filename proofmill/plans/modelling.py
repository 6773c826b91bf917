"""Queries that fit and compare models."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill.operators import features as FT
from proofmill.operators import models as MD
from proofmill.plans.aggregates import rounded
from proofmill.plans.measurements import rnd
from proofmill.plans.regimes import poisson_sql
from proofmill.plans.registry import query

FEATURES = ("l_quantity", "l_discount", "l_tax")


NUMBERS = "l_quantity::double, l_discount::double, l_tax::double"
SUBSETS = {"all": FEATURES, "quantity": FEATURES[:1], "rates": FEATURES[1:]}
BASE = "select 'G'||l_suppkey as grp, (l_orderkey%5)::int as fold, [1.0::double, l_quantity::double, l_discount::double, l_tax::double, log10(l_extendedprice)::double] as x from lineitem"


def moments_sql(name: str, rows: str, key: str, weight: str = "1") -> str:
    """CTE ``name`` (key, i, j, v): sums of products of [1, features, target]."""
    return f"{name} as materialized (select {key}, i, j, sum({weight}*x[i+1]*x[j+1]) as v from ({rows}), range(5) a(i), range(5) b(j) group by all)"


def fits_sql(name: str, moments: str, keys: str, candidates: str) -> str:
    """CTE ``name``_f (keys, family, alpha, w): ridge weights, the intercept first and -1 for the target last, by Gauss and Jordan on standardised columns.

    ``moments`` has keys, i, j, v; ``candidates`` has family, alpha, features (their numbers).
    """
    k = keys.split(", ")
    on = lambda a, b, extra=(): " and ".join(f"{a}.{c}={b}.{c}" for c in [*k, *extra])
    fa = ("family", "alpha")
    steps = [
        f"{name}_n as (select {keys}, v as n from {moments} where i=0 and j=0)",
        f"{name}_a as (select m.{', m.'.join(k)}, m.i, m.v/n as mean, sqrt(greatest(q.v/n-(m.v/n)**2,0)) as sd from {moments} m join {name}_n n on {on('m', 'n')} join {moments} q on {on('m', 'q')} and q.i=m.i and q.j=m.i where m.j=0 and m.i>0)",
        f"{name}_0 as materialized (select m.{', m.'.join(k)}, family, alpha, m.i, m.j, (m.v/n-a.mean*b.mean)/(a.sd*case when m.j=4 then 1 else b.sd end)+case when m.i=m.j then alpha/n else 0 end as v from {moments} m join {name}_n n on {on('m', 'n')} join {name}_a a on {on('m', 'a')} and a.i=m.i join {name}_a b on {on('m', 'b')} and b.i=m.j, ({candidates}) c where list_contains(features, m.i) and (m.j=4 or list_contains(features, m.j)))",
    ]
    for f in range(1, 4):
        was = f"{name}_{f - 1}"
        same = on("a", "{0}", fa)
        steps.append(
            f"{name}_{f} as materialized (select a.* replace (case when p.v is null then a.v when a.i={f} then a.v/p.v else a.v-c.v*r.v/p.v end as v) from {was} a left join {was} p on {same.format('p')} and p.i={f} and p.j={f} left join {was} r on {same.format('r')} and r.i={f} and r.j=a.j left join {was} c on {same.format('c')} and c.i=a.i and c.j={f})"
        )
    steps.append(f"{name}_w as (select s.{', s.'.join(k)}, family, alpha, s.i, s.v/a.sd as w, s.v/a.sd*a.mean as shift from {name}_3 s join {name}_a a on {on('s', 'a')} and a.i=s.i where s.j=4)")
    steps.append(
        f"{name}_f as (select {keys}, family, alpha, i, w from {name}_w union all select w.{', w.'.join(k)}, family, alpha, 0, any_value(a.mean)-sum(shift) from {name}_w w join {name}_a a on {on('w', 'a')} and a.i=4 group by w.{', w.'.join(k)}, family, alpha"
        f" union all select distinct {keys}, family, alpha, 4, -1.0::double from {name}_w)"
    )
    return ",\n".join(steps)


def grid_sql(alphas) -> str:
    number = {c: i for i, c in enumerate(FEATURES, 1)}
    return "select * from (values " + ", ".join(f"('{f}', {float(a)!r}::double, {[number[c] for c in cs]})" for f, cs in SUBSETS.items() for a in alphas) + ") g(family, alpha, features)"


def cv_sql(name: str, rows: str, candidates: str) -> str:
    """CTE ``name`` (family, alpha, n, rmse) of grouped cross-validation by fold."""
    train = f"select a.fold, a.i, a.j, t.v-a.v as v from {name}_m a join (select i, j, sum(v) as v from {name}_m group by 1,2) t on t.i=a.i and t.j=a.j"
    return f"""{moments_sql(name + '_m', rows, 'fold')}, {name}_t as materialized ({train}),
{fits_sql(name, name + '_t', 'fold', candidates)},
{name}_e as (select x.fold, x.family, x.alpha, sum(x.w*y.w*m.v) as e from {name}_f x join {name}_f y on y.fold=x.fold and y.family=x.family and y.alpha=x.alpha join {name}_m m on m.fold=x.fold and m.i=x.i and m.j=y.i group by 1,2,3),
{name} as (select family, alpha, (select sum(v) from {name}_m where i=0 and j=0)::bigint as n, sqrt(greatest(sum(e)/(select sum(v) from {name}_m where i=0 and j=0),0)) as rmse from {name}_e group by 1,2)"""


def table(t):
    return t.lineitem.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        F.concat(F.lit("G"), F.col("l_suppkey")).alias("grp"),
        (F.col("l_orderkey") % 5).cast("int").alias("fold"),
        *FEATURES,
        F.log10("l_extendedprice").alias("y"),
        F.col("l_returnflag").alias("stratum"),
    )


@query("ridge_selection", f"""
with {cv_sql('a', BASE, grid_sql((0.1, 1.0, 10.0)))}
select family, alpha, n, round(rmse,7) as rmse from a union all
select 'mean', 0.0, sum(n)::bigint, round(sqrt(sum(e)/sum(n)),7) from (select count(*) as n, sum((x[5]-m)**2) as e from ({BASE}) b join (select k.fold, avg(x[5]) as m from (select distinct fold from ({BASE})) k join ({BASE}) r on r.fold<>k.fold group by 1) o on o.fold=b.fold)
""")
def ridge_selection(t):
    """Candidate comparison: out-of-fold mean and ridge at several penalties and feature subsets."""
    s = MD.moment_sums(table(t), FEATURES, "y", "fold")
    subs = {"all": FEATURES, "quantity": FEATURES[:1], "rates": FEATURES[1:]}
    return rounded(t.spark.createDataFrame(MD.cross_validate(s, FEATURES, (0.1, 1.0, 10.0), subs), "family string, alpha double, n long, rmse double"), 7)


@query("nested_validation", f"""
with {moments_sql('m', BASE, 'fold')}, p as (select a.fold as outer_fold, b.fold as fold, b.i, b.j, b.v from (select distinct fold from m) a join m b on b.fold<>a.fold),
tr as materialized (select p.outer_fold, p.fold, p.i, p.j, t.v-p.v as v from p join (select outer_fold, i, j, sum(v) as v from p group by 1,2,3) t on t.outer_fold=p.outer_fold and t.i=p.i and t.j=p.j),
{fits_sql('a', 'tr', 'outer_fold, fold', grid_sql((0.1, 100.0, 10000.0)))},
e as (select x.outer_fold, x.family, x.alpha, sum(x.w*y.w*m.v) as e from a_f x join a_f y on y.outer_fold=x.outer_fold and y.fold=x.fold and y.family=x.family and y.alpha=x.alpha join m on m.fold=x.fold and m.i=x.i and m.j=y.i group by 1,2,3),
c as (select e.*, sqrt(e/n) as rmse, row_number() over (partition by e.outer_fold order by round(sqrt(e/n),12), family, alpha) as rk from e join (select outer_fold, sum(v) as n from p where i=0 and j=0 group by 1) n using (outer_fold)),
ot as materialized (select outer_fold as fold, i, j, sum(v) as v from p group by 1,2,3), {fits_sql('b', 'ot', 'fold', grid_sql((0.1, 100.0, 10000.0)))},
o as (select x.fold, x.family, x.alpha, sum(x.w*y.w*m.v) as e from b_f x join b_f y on y.fold=x.fold and y.family=x.family and y.alpha=x.alpha join m on m.fold=x.fold and m.i=x.i and m.j=y.i group by 1,2,3)
select o.fold, o.family, o.alpha, round(c.rmse,7) as inner_rmse, n.v::bigint as n, round(sqrt(o.e/n.v),7) as outer_rmse from o join c on c.outer_fold=o.fold and c.family=o.family and c.alpha=o.alpha and c.rk=1 join m n on n.fold=o.fold and n.i=0 and n.j=0
""")
def nested_validation(t):
    s = MD.moment_sums(table(t), FEATURES, "y", "fold")
    rows = MD.nested_validation(s, FEATURES, (0.1, 100.0, 10000.0), SUBSETS)
    return rounded(t.spark.createDataFrame(rows, "fold int, family string, alpha double, inner_rmse double, n long, outer_rmse double"), 7)


@query("out_of_fold_baseline", """
with f as (select *, log10(l_extendedprice) as y, (l_orderkey%5)::int as fold from lineitem), b as (select k.fold, regr_slope(y, l_quantity) as s, regr_intercept(y, l_quantity) as i from (select distinct fold from f) k join f on f.fold<>k.fold group by 1)
select f.fold, count(*) as n, round(sqrt(avg(pow(y-(i+s*l_quantity),2))),6) as rmse from f join b on b.fold=f.fold group by 1
""")
def out_of_fold_baseline(t):
    """Unpenalised single-feature fit, checked against per-fold regression in SQL."""
    d = table(t)
    s = MD.moment_sums(d, ["l_quantity"], "y", "fold")
    p = MD.out_of_fold(d, s, ["l_quantity"], "fold", 0.0, "p")
    e = F.col("y") - F.col("p")
    return rounded(p.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse")))


@query("grouped_benchmark")
def grouped_benchmark(t):
    return MD.grouped_benchmark(table(t), FEATURES, "y", "fold", (0.1, 1.0, 10.0))


def _halving_sql(alphas, fractions) -> str:
    steps, last = [], len(fractions)
    for k, fraction in enumerate(fractions, 1):
        rows = BASE if fraction >= 1 else f"select * from ({BASE}) where ('0x'||substr(md5('5:'||grp),1,8))::bigint/4294967296.0::double<{fraction}"
        before = "" if k == 1 else f" where exists (select 1 from k{k - 1} o where o.kept and o.family=g.family and o.alpha=g.alpha)"
        steps.append(cv_sql(f"s{k}", rows, grid_sql(alphas) + before))
        keep = "rk=1" if k == last else "rk<=greatest(1,c//2) or fk=1"
        steps.append(f"k{k} as (select *, {keep} as kept, {k} as stage from (select *, row_number() over (order by round(rmse,12), family, alpha) as rk, row_number() over (partition by family order by round(rmse,12), alpha) as fk, count(*) over () as c from s{k}))")
    return "with " + ",\n".join(steps) + " " + " union all ".join(f"select stage, family, alpha, n, round(rmse,7) as rmse, kept from k{k}" for k in range(1, last + 1))


@query("model_grid_halving", _halving_sql((0.1, 10.0, 1000.0, 100000.0), (0.25, 0.5, 1.0)))
def model_grid_halving(t):
    rows = MD.successive_halving(table(t), FEATURES, "y", "fold", "grp", (0.1, 10.0, 1000.0, 100000.0), SUBSETS, fractions=(0.25, 0.5, 1.0), seed=5)
    return rounded(t.spark.createDataFrame(rows, "stage int, family string, alpha double, n long, rmse double, kept boolean"), 7)


@query("train_standardization", """
select l_orderkey, l_linenumber, l_partkey, round((l_quantity-m)/s,6) as l_quantity_std, round((l_tax-mt)/st,6) as l_tax_std from lineitem, (select avg(l_quantity) as m, stddev_pop(l_quantity) as s, avg(l_tax) as mt, stddev_pop(l_tax) as st from lineitem where l_orderkey%5<>0)
""")
def train_standardization(t):
    d = t.lineitem.withColumn("train", F.col("l_orderkey") % 5 != 0)
    return MD.standardize_by_train(d, ["l_quantity", "l_tax"], "train").select("l_orderkey", "l_linenumber", "l_partkey", *rnd("l_quantity_std", "l_tax_std"))


@query("feature_layers", """
select p_partkey, case when p_size<=25 then q end as mean_quantity, case when p_size<=25 then n end as n_orders from part left join (select l_partkey, round(avg(l_quantity),6) as q from lineitem group by 1) a on a.l_partkey=p_partkey left join (select l_partkey, count(*) as n from lineitem group by 1) b on b.l_partkey=p_partkey
""")
def feature_layers(t):
    a = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))
    b = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    base = t.part.select("p_partkey", (F.col("p_size") <= 25).alias("ok"))
    return MD.merge_layers(base, [a, b], "p_partkey", {"mean_quantity", "n_orders"}, "ok").drop("ok")


def censored(t):
    d = table(t)
    y = F.col("y")
    return d.withColumns(
        {
            "lo": F.when(F.col("stratum") == "A", None).when(F.col("stratum") == "N", F.floor(y * 2) / 2).otherwise(y),
            "hi": F.when(F.col("stratum") == "A", F.ceil(y * 2) / 2).when(F.col("stratum") == "N", None).otherwise(y),
        }
    )


@query("censored_regression")
def censored_regression(t):
    f = MD.censored_ridge(censored(t), FEATURES, "lo", "hi", alpha=1.0)
    p = MD.probability_at_least(f["model"], f["sigma"], 4.5)
    d = table(t).withColumn("p", p)
    return d.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_probability"), F.lit(f["sigma"]).alias("sigma"))


@query("censoring_sensitivity")
def censoring_sensitivity(t):
    rows = MD.censoring_scenarios(censored(t), FEATURES, "lo", "hi")
    return t.spark.createDataFrame(rows, "scenario string, n long, sigma double, intercept double, l_quantity double, l_discount double, l_tax double")


SEEDED = f"""
w as (select r.r as seed, grp, {poisson_sql(31, 'r.r', 'grp')} as weight from (select distinct grp from ({BASE})), range(1,7) r(r)),
{moments_sql('m', f'select seed, weight, x from ({BASE}) join w using (grp) where weight>0', 'seed', 'weight')},
{fits_sql('a', 'm', 'seed', "select 'all' as family, 1.0::double as alpha, [1,2,3] as features")}
"""


@query("seeded_refits", f"with {SEEDED} select f.seed::int as seed, m.v as n, round(max(w) filter (f.i=0),6) as intercept, round(max(w) filter (f.i=1),6) as quantity, round(max(w) filter (f.i=2),4) as discount, round(max(w) filter (f.i=3),4) as tax from a_f f join m on m.seed=f.seed and m.i=0 and m.j=0 group by 1,2")
def seeded_refits(t):
    f = MD.seeded_refits(table(t), "grp", FEATURES, "y", 1.0, 6, 31)
    c = F.col("coefficients")
    return f.select("seed", "n", F.round("intercept", 6).alias("intercept"), F.round(c[0], 6).alias("quantity"), F.round(c[1], 4).alias("discount"), F.round(c[2], 4).alias("tax"))


@query("seed_stability", f"""
with {SEEDED}, b as (select seed, max(w) filter (i=0) as w0, max(w) filter (i=1) as w1, max(w) filter (i=2) as w2, max(w) filter (i=3) as w3 from a_f group by 1),
p as (select l_orderkey||':'||l_linenumber||':'||l_partkey||':'||l_suppkey as row_id, w0+w1*l_quantity+w2*l_discount+w3*l_tax as p from lineitem, b)
select row_id, round(avg(p),5) as mean, round(stddev_samp(p),5) as sd, round(max(p)-min(p),5) as range from p group by 1
""")
def seed_stability(t):
    d = table(t)
    s = MD.seed_stability(d, MD.seeded_refits(d, "grp", FEATURES, "y", 1.0, 6, 31), FEATURES)
    return rounded(s.select("row_id", "mean", "sd", "range"), 5)


@query("forest_regression")
def forest_regression(t):
    p = MD.forest_out_of_fold(table(t), FEATURES, "y", "fold", range(5), trees=10, depth=5)
    e = F.col("y") - F.col("predicted")
    return p.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def labelled(t):
    d = t.scores.withColumns({"fold": (F.col("doc_id") % 3).cast("int"), "x1": F.col("score_b"), "x2": F.col("toxic").cast("double")})
    return MD.assemble(d.withColumn("label", F.col("label").cast("double")), ["x1", "x2"])


@query("classifier_selection")
def classifier_selection(t):
    """Prior, logistic and forest candidates compared on out-of-fold probabilities."""
    from proofmill.operators.metrics import classification_metrics

    cands = {
        "prior": ("prior", {}),
        "logistic_weak": ("logistic", {"regParam": 0.1, "maxIter": 30}),
        "logistic_strong": ("logistic", {"regParam": 0.001, "maxIter": 30}),
        "forest": ("forest", {"numTrees": 10, "maxDepth": 4, "seed": 13}),
    }
    p = MD.classifier_out_of_fold(labelled(t).select("doc_id", "label", "fold", "features"), "label", "fold", range(3), cands)
    return classification_metrics(p, "label", "score", keys=["candidate"]).select("candidate", "n", "roc_auc", "log_loss", "brier")


@query("calibrated_scores")
def calibrated_scores(t):
    d = t.scores.withColumns({"label": F.col("label").cast("double"), "fold": F.col("doc_id") % 3})
    d = MD.cross_calibrated(d, "label", "score", "fold", range(3))
    return d.select("doc_id", "calibrated", MD.entropy("calibrated").alias("entropy"), MD.score_bands("calibrated").alias("band"))


@query("cluster_split")
def cluster_split(t):
    return MD.cluster_holdout(MD.cluster_groups(t.embeddings, "vec_id", "embedding"), "vec_id")


@query("residual_clusters")
def residual_clusters(t):
    e = F.log10("l_extendedprice") - F.log10(F.col("l_quantity") * 3000)
    w = t.lineitem.groupBy("l_partkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg(e))
    c = MD.residual_clusters(w, "l_partkey", ["A", "N", "R"], 4)
    means = [F.avg(x).alias(f"mean_{x.lower()}") for x in "ANR"]
    return c.join(w, "l_partkey").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *means)


@query("hybrid_classifier")
def hybrid_classifier(t):
    from proofmill.operators.metrics import classification_metrics

    h = t.embeddings.select("vec_id", (F.col("label") < 5).cast("double").alias("label"), (F.col("vec_id") % 2).cast("int").alias("fold"), "embedding")
    p = MD.hybrid_out_of_fold(h, "embedding", "label", "fold", range(2), 8, 6, regParam=0.01, maxIter=30).withColumn("candidate", F.lit("logistic"))
    return classification_metrics(p, "label", "score", keys=["candidate"]).select("candidate", "n", "roc_auc", "brier")


@query("stacked_and_gated")
def stacked_and_gated(t):
    d = table(t)
    s = MD.moment_sums(d, FEATURES, "y", "fold")
    d = MD.out_of_fold(d, s, FEATURES, "fold", 1.0, "expert_quantity", FEATURES[:1])
    d = MD.out_of_fold(d, s, FEATURES, "fold", 1.0, "expert_rates", FEATURES[1:])
    d = MD.stack_experts(d, ["expert_quantity", "expert_rates"], "y", "fold")
    d = MD.gate_experts(d, ["expert_quantity", "expert_rates"], FEATURES, "y", "fold")
    err = lambda c: F.avg(F.abs(F.col("y") - F.col(c)))
    return d.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), err("expert_quantity").alias("quantity_mae"), err("expert_rates").alias("rates_mae"), err("stacked").alias("stacked_mae"), err("gated").alias("gated_mae")
    )


@query("block_permutation")
def block_permutation(t):
    d = table(t)
    e = MD.block_effects(d, "row_id", FEATURES, ("l_quantity",), "y", "fold", "stratum", alpha=1.0, replicates=3, seed=17)
    return e.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("permuted_abs_error") - F.col("baseline_abs_error")).alias("permutation_effect"),
        F.avg(F.col("ablated_abs_error") - F.col("baseline_abs_error")).alias("ablation_effect"),
    )


@query("transfer_permutation_test")
def transfer_permutation_test(t):
    d = table(t)
    r = MD.transfer_permutation(
        d.where("stratum = 'A' and fold <> 0"), d.where("stratum = 'N'"), "row_id", FEATURES, "y", d.where("stratum = 'A' and fold = 0"), alpha=1.0, replicates=10, seed=23
    )
    return t.spark.createDataFrame([r], "baseline_rmse double, gain double, null_mean_gain double, p_value double, replicates long")


@query("hashed_ngrams", """
with g as (select doc_id, unnest(list_distinct(flatten(list_transform([2,3,4], lambda n: list_transform(range(1, length(t)-n+2), lambda i: substr(t,i,n)))))) as g from (select doc_id, trim(text) as t from documents))
select d.doc_id, count(distinct ('0x'||substr(md5(g),1,8))::bigint%1024) as n_bits, sha256(coalesce(array_to_string(list_sort(list(distinct (('0x'||substr(md5(g),1,8))::bigint%1024)::int)),','),'')) as bits from documents d left join g using (doc_id) group by 1
""")
def hashed_ngrams(t):
    d = FT.hashed_ngrams(t.documents.select("doc_id", "text"), "text", "bits", 2, 4, 1024)
    return d.select("doc_id", F.size("bits").cast("long").alias("n_bits"), F.sha2(F.array_join(F.col("bits").cast("array<string>"), ","), 256).alias("bits"))
