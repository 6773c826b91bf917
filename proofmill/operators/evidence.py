"""Derived quantities and evidence audits computed from grouped measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions.values import normal_cdf
from proofmill.operators.ranking import benjamini_hochberg, group_quantiles, null_safe_join, ranked_values
from proofmill.session import cut_lineage


def stack(df: DataFrame, keys, name: str, value: str, columns) -> DataFrame:
    """Unpivot numeric columns to (keys, name, value), NULLs kept."""
    items = F.array(
        *[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]
    )
    return df.select(*keys, F.explode(items).alias("x")).select(*keys, f"x.{name}", f"x.{value}")


def closure(df: DataFrame, study: str, *, tolerance: float = 0.05, points: float = 5.0) -> DataFrame:
    """Recompute clearance = dose/AUC and availability = 100 * dose-corrected AUC ratio per study.

    Expects columns arm ('iv'/'po'), dose, auc, reported_cl, reported_f.  Clearance closes within the
    relative ``tolerance``, availability within absolute percentage ``points``.
    """
    iv, po = F.col("arm") == "iv", F.col("arm") == "po"
    g = df.groupBy(study).agg(
        F.max(F.when(iv, F.col("dose"))).alias("iv_dose"),
        F.max(F.when(iv, F.col("auc"))).alias("iv_auc"),
        F.max(F.when(po, F.col("dose"))).alias("po_dose"),
        F.max(F.when(po, F.col("auc"))).alias("po_auc"),
        F.max("reported_cl").alias("reported_cl"),
        F.max("reported_f").alias("reported_f"),
    )
    cl = F.col("iv_dose") / F.nullif(F.col("iv_auc"), F.lit(0.0))
    av = 100.0 * F.col("po_auc") * F.col("iv_dose") / F.nullif(F.col("iv_auc") * F.col("po_dose"), F.lit(0.0))
    g = g.withColumns({"cl": cl, "availability": av})
    err_cl = F.abs(F.col("reported_cl") - F.col("cl")) / F.greatest(F.abs(F.col("cl")), F.lit(1e-12))
    err_f = F.abs(F.col("reported_f") - F.col("availability"))
    g = g.withColumns({"cl_relative_error": err_cl, "f_error_points": err_f})
    worst = F.greatest(F.col("cl_relative_error") / tolerance, F.col("f_error_points") / points)
    return g.withColumn(
        "status", F.when(worst.isNull(), "not_computable").when(worst <= 1, "closed").otherwise("open")
    )


def reciprocal_interval(numerator: float, lower, upper) -> tuple[Column, Column]:
    """Bounds of numerator / x for a positive interval: they cross."""
    return (
        F.when(F.col(upper) > 0, F.lit(numerator) / F.col(upper)),
        F.when(F.col(lower) > 0, F.lit(numerator) / F.col(lower)),
    )


def margin(effect: str, exposure: str, fraction: str) -> Column:
    """effect / (exposure * fraction), only when all three are present and positive."""
    ok = (F.col(effect) > 0) & (F.col(exposure) > 0) & (F.col(fraction) > 0)
    return F.when(ok, F.col(effect) / (F.col(exposure) * F.col(fraction)))


def dispersion(df: DataFrame, subject: str, stratum: str, value: str) -> DataFrame:
    """Range and sample deviation of repeated values per subject, summarised per stratum."""
    per = df.where(F.col(value).isNotNull()).groupBy(stratum, subject).agg(
        F.count(F.lit(1)).alias("n"),
        (F.max(value) - F.min(value)).alias("range"),
        F.stddev_samp(value).alias("sd"),
    )
    rep = per.where(F.col("n") >= 2)
    out = per.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("n_subjects"),
        F.count_if(F.col("n") >= 2).alias("n_repeated"),
        F.max(F.when(F.col("n") >= 2, F.col("range"))).alias("max_range"),
        F.avg(F.when(F.col("n") >= 2, F.col("sd"))).alias("mean_sd"),
    )
    med = group_quantiles(rep, "range", {"median_range": 0.5}, [stratum])
    return null_safe_join(out, med, [stratum], "left")


def selection_bias(df: DataFrame, flag: str, columns, keys=()) -> DataFrame:
    """Available-vs-missing comparison per column: standardised difference, Mann-Whitney z, BH q."""
    long = stack(df, [*keys, flag], "feature", "value", columns).where(F.col("value").isNotNull())
    long = long.withColumn("__on", F.col(flag).cast("int"))
    on = F.col("__on") == 1
    m = long.groupBy("feature").agg(
        F.count_if(on).alias("n_available"),
        F.count_if(~on).alias("n_missing"),
        F.avg(F.when(on, F.col("value"))).alias("m1"),
        F.avg(F.when(~on, F.col("value"))).alias("m0"),
        F.var_samp(F.when(on, F.col("value"))).alias("v1"),
        F.var_samp(F.when(~on, F.col("value"))).alias("v0"),
    )
    r = ranked_values(long, "value", ["feature"], ["__on"])
    avg_rank = F.col("n_before") + (F.col("n_tied") + 1) / 2
    t = F.col("n_tied").cast("double")
    u = r.groupBy("feature").agg(
        F.sum(avg_rank * F.col("__on_tied")).alias("rank_sum"), F.sum(t * t * t - t).alias("ties")
    )
    d = m.join(u, "feature")
    n1, n0 = F.col("n_available").cast("double"), F.col("n_missing").cast("double")
    n = n1 + n0
    d = d.withColumn("u_statistic", F.col("rank_sum") - n1 * (n1 + 1) / 2)
    var = n1 * n0 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    d = d.withColumn("z", (F.col("u_statistic") - n1 * n0 / 2) / F.sqrt(var))
    d = d.withColumn("p", 2 * (1 - normal_cdf(F.abs(F.col("z")))))
    d = d.withColumn("smd", (F.col("m1") - F.col("m0")) / F.sqrt((F.col("v1") + F.col("v0")) / 2))
    return benjamini_hochberg(d, "p", "q").select(
        "feature", "n_available", "n_missing", "smd", "u_statistic", "z", "p", "q"
    )


def weighted_ensemble(df: DataFrame, keys, value: str, weight: str, quantiles=(0.05, 0.5, 0.95)) -> DataFrame:
    """Weighted mean, deviation, inverse-CDF quantiles, effective count and entropy per group."""
    keys = list(keys)
    src = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).withColumn("__w", F.col(weight))
    w, x = F.col("__w"), F.col(value)
    m = src.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_members"),
        F.sum(w).alias("w"),
        F.sum(w * x).alias("wx"),
        F.sum(w * x * x).alias("wxx"),
        F.sum(w * w).alias("ww"),
        F.sum(w * F.log(w)).alias("wlw"),
        F.min(x).alias("value_min"),
        F.max(x).alias("value_max"),
    )
    r = ranked_values(src, value, keys, ["__w"])
    reach = F.col("__w_before") + F.col("__w_tied")
    q = r.groupBy(*keys).agg(
        *[F.min(F.when(reach >= p * F.col("__w_group"), F.col(value))).alias(f"q{int(p * 100):02d}") for p in quantiles]
    )
    mean = F.col("wx") / F.col("w")
    out = null_safe_join(m, q, keys)
    return out.select(
        *keys,
        "n_members",
        mean.alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("wxx") / F.col("w") - mean * mean)).alias("sd"),
        *[f"q{int(p * 100):02d}" for p in quantiles],
        (F.col("w") * F.col("w") / F.col("ww")).alias("effective_count"),
        (F.log("w") - F.col("wlw") / F.col("w")).alias("entropy"),
        "value_min",
        "value_max",
        (F.col("value_max") - F.col("value_min")).alias("span"),
    )


def boltzmann(df: DataFrame, keys, energy: str, kt: float, out: str = "weight") -> DataFrame:
    """exp(-(E - min E)/kT) normalised within each group."""
    keys = list(keys)
    floor = df.groupBy(*keys).agg(F.min(energy).alias("__e0"))
    d = null_safe_join(df, floor, keys).withColumn("__b", F.exp(-(F.col(energy) - F.col("__e0")) / kt))
    total = d.groupBy(*keys).agg(F.sum("__b").alias("__z"))
    return null_safe_join(d, total, keys).withColumn(out, F.col("__b") / F.col("__z")).drop("__e0", "__b", "__z")


def batch_offsets(df: DataFrame, value: str, subject: str, priors: dict) -> DataFrame:
    """Remove shrunken mean residuals factor by factor; adds ``corrected`` and ``total_offset``.

    Residuals are taken from the subject's median, so differences between subjects never enter an
    offset.  ``priors``: factor -> prior weight, in the order of removal; a missing level is a level
    of its own.  All levels come from one stored table of sums per factor combination.
    """
    factors = list(priors)
    centre = group_quantiles(df, value, {"__c": 0.5}, [subject])
    d = null_safe_join(df, centre, [subject], "left").withColumn("__r", F.col(value) - F.col("__c")).drop("__c")
    cells = cut_lineage(d.groupBy(*factors).agg(F.sum("__r").alias("__s"), F.count("__r").alias("__n"))).withColumn("__o", F.lit(0.0))
    for f in factors:
        lv = cells.groupBy(f).agg((F.sum(F.col("__s") - F.col("__o") * F.col("__n")) / (F.sum("__n") + F.lit(float(priors[f])))).alias("__f"))
        cells = cut_lineage(null_safe_join(cells, lv, [f]).withColumn("__o", F.col("__o") + F.coalesce("__f", F.lit(0.0))).drop("__f"))
    out = null_safe_join(d, cells.select(*factors, F.col("__o").alias("total_offset")), factors)
    return out.withColumn("corrected", F.col(value) - F.col("total_offset")).drop("__r")


def feature_qc(df: DataFrame, columns, train: str) -> DataFrame:
    """Missing count, constant-in-train and standardised train/test mean shift per column, one pass."""
    aggs = []
    tr = F.col(train)
    for c in columns:
        x = F.col(c)
        aggs += [
            F.count_if(x.isNull()).alias(f"{c}__0"),
            F.coalesce(F.min(F.when(tr, x)) == F.max(F.when(tr, x)), F.lit(True)).alias(f"{c}__1"),
            ((F.avg(F.when(~tr, x)) - F.avg(F.when(tr, x))) / F.stddev_samp(F.when(tr, x))).alias(f"{c}__2"),
        ]
    one = df.agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.col(f"{c}__0").alias("n_missing"),
                    F.col(f"{c}__1").alias("constant_in_train"),
                    F.col(f"{c}__2").alias("mean_shift"),
                )
                for c in columns
            ]
        )
    )
    return one.select(rows.alias("x")).select("x.*")


def correlated_pairs(df: DataFrame, columns, threshold: float = 0.0) -> DataFrame:
    """Pearson correlation of every column pair in one aggregate over the full table."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"__{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"__{i}").alias("r"))
                for i, (a, b) in enumerate(pairs)
            ]
        )
    )
    return one.select(rows.alias("x")).select("x.*").where(F.abs("r") >= threshold)


def banzhaf_pairs(df: DataFrame, mask: str, value: str, players: int) -> DataFrame:
    """Mean second difference per player pair over a complete coalition table.

    Each coalition contributes once per pair with sign + when it holds both or neither of the two
    players, so no self-join over masks is needed.
    """
    pairs = [(i, j) for i in range(players) for j in range(i + 1, players)]
    m = F.col(mask)
    terms = []
    for i, j in pairs:
        bi = F.shiftright(m, i).bitwiseAND(F.lit(1))
        bj = F.shiftright(m, j).bitwiseAND(F.lit(1))
        sign = F.when(bi == bj, 1.0).otherwise(-1.0)
        terms.append(F.avg(sign * F.col(value)).alias(f"{i}_{j}"))
    one = df.agg(*terms)
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(f"{i}_{j}") * 4).alias("interaction"))
                for i, j in pairs
            ]
        )
    )
    return one.select(rows.alias("x")).select("x.*")


def threshold_mass(df: DataFrame, keys, value: str, mass: str, thresholds) -> DataFrame:
    """Count and mass at or above each threshold per group, retained and omitted mass."""
    keys = list(keys)
    x, w = F.col(value), F.col(mass)
    aggs = [F.sum(w).alias("total_mass")]
    for i, t in enumerate(thresholds):
        aggs += [F.count_if(x >= t).alias(f"n{i}"), F.coalesce(F.sum(F.when(x >= t, w)), F.lit(0.0)).alias(f"m{i}")]
    g = df.groupBy(*keys).agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(float(t)).alias("threshold"),
                    F.col(f"n{i}").alias("n_at_or_above"),
                    F.col(f"m{i}").alias("retained_mass"),
                    (F.col("total_mass") - F.col(f"m{i}")).alias("omitted_mass"),
                )
                for i, t in enumerate(thresholds)
            ]
        )
    )
    return g.select(*keys, rows.alias("x")).select(*keys, "x.*")


def prefix_convergence(df: DataFrame, keys, rank: str, value: str, weight: str, depths, tolerance: float) -> DataFrame:
    """Weighted mean at nested depths, the last two changes and an escalation flag per group."""
    keys = list(keys)
    x, w, r = F.col(value), F.col(weight), F.col(rank)
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_members"),
        *[
            (F.sum(F.when(r <= d, w * x)) / F.sum(F.when(r <= d, w))).alias(f"mean_at_{d}")
            for d in depths
        ],
    )
    a, b, c = depths[-3:]
    last = F.abs(F.col(f"mean_at_{c}") - F.col(f"mean_at_{b}"))
    prev = F.abs(F.col(f"mean_at_{b}") - F.col(f"mean_at_{a}"))
    return g.withColumns({"last_change": last, "previous_change": prev}).withColumn(
        "escalate", F.greatest("last_change", "previous_change") > tolerance
    )


def sample_size(df: DataFrame, subject: str, endpoint: str, value: str, half_width: float, z: float = 1.96) -> DataFrame:
    """ceil((z * sd / h)^2) per endpoint from the spread of subject means."""
    per = df.where(F.col(value).isNotNull()).groupBy(endpoint, subject).agg(F.avg(value).alias("m"))
    g = per.groupBy(endpoint).agg(F.count(F.lit(1)).alias("n_subjects"), F.stddev_samp("m").alias("sd"))
    need = F.ceil(F.pow(F.lit(z) * F.col("sd") / F.lit(half_width), 2)).cast("long")
    return g.withColumn("required_n", need)


def hill_consistency(df: DataFrame, subject: str, conc: str, response: str, ic50: str) -> DataFrame:
    """Median midpoint per subject against each concentration response under slope one."""
    med = group_quantiles(df, ic50, {"median_ic50": 0.5}, [subject])
    d = null_safe_join(df, med, [subject])
    expected = 100.0 * F.col(conc) / (F.col(conc) + F.col("median_ic50"))
    return d.withColumn("expected", expected).withColumn("deviation", F.col(response) - F.col("expected"))


def alias_conflicts(df: DataFrame, key: str, alias: str, value: str) -> DataFrame:
    """Keys registered under more than one alias with more than one value."""
    g = df.groupBy(key).agg(
        F.min(alias).alias("alias_min"),
        F.max(alias).alias("alias_max"),
        F.min(value).alias("value_min"),
        F.max(value).alias("value_max"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    return g.where((F.col("alias_min") < F.col("alias_max")) & (F.col("value_min") < F.col("value_max")))


def gate_table(df: DataFrame, entity: str, gates) -> DataFrame:
    """One row per entity and gate: (name, value, threshold, passed, severity).

    ``gates``: (name, column, comparison '<='|'>=', threshold, severity).
    """
    items = []
    for name, column, op, threshold, severity in gates:
        v = F.col(column).cast("double")
        ok = (v <= threshold) if op == "<=" else (v >= threshold)
        items.append(
            F.struct(
                F.lit(name).alias("gate"),
                v.alias("value"),
                F.lit(float(threshold)).alias("threshold"),
                F.coalesce(ok, F.lit(False)).alias("passed"),
                F.lit(severity).alias("severity"),
            )
        )
    return df.select(entity, F.explode(F.array(*items)).alias("x")).select(entity, "x.*")


def admissibility(gates: DataFrame, entity: str) -> DataFrame:
    """Decision per entity: substantive failures reject, sampling failures only escalate."""
    g = gates.groupBy(entity).agg(
        F.count_if(~F.col("passed") & (F.col("severity") == "substantive")).alias("substantive_failures"),
        F.count_if(~F.col("passed") & (F.col("severity") == "sampling")).alias("sampling_failures"),
    )
    return g.withColumn(
        "decision",
        F.when(F.col("substantive_failures") > 0, "reject")
        .when(F.col("sampling_failures") > 0, "extend_sampling")
        .otherwise("admit"),
    )


def metric_ladder(df: DataFrame, fields) -> DataFrame:
    """First available metric in the given order, with its name."""
    pick = F.coalesce(
        *[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("name"), F.col(f).cast("double").alias("value"))) for f in fields]
    )
    return df.withColumn("__p", pick).withColumns(
        {"metric_name": F.col("__p.name"), "metric_value": F.col("__p.value")}
    ).drop("__p")
