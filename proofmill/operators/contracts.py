"""Typed table contracts: schema, keys, value rules, links, and validated sinks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill.functions.text import blank_to_null


@dataclass(frozen=True)
class Field:
    name: str
    type: T.DataType
    required: bool = True
    enum: tuple = ()
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Contract:
    name: str
    fields: tuple
    key: tuple
    checks: dict = field(default_factory=dict)  # name -> SQL condition that must hold (NULL passes)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type, not f.required) for f in self.fields])


class ContractError(ValueError):
    pass


def schema_problems(df: DataFrame, contract: Contract) -> list[str]:
    have = {f.name: f.dataType for f in df.schema}
    out = [f"missing column {f.name}" for f in contract.fields if f.name not in have]
    out += [f"unexpected column {c}" for c in have if c not in {f.name for f in contract.fields}]
    out += [
        f"column {f.name} is {have[f.name].simpleString()}, expected {f.type.simpleString()}"
        for f in contract.fields
        if f.name in have and have[f.name] != f.type
    ]
    return out


def row_rules(contract: Contract) -> dict[str, Column]:
    """Violation conditions by name."""
    rules: dict[str, Column] = {}
    for f in contract.fields:
        c = F.col(f.name)
        if f.required:
            rules[f"required:{f.name}"] = blank_to_null(f.name).isNull() if isinstance(f.type, T.StringType) else c.isNull()
        if f.enum:
            rules[f"enum:{f.name}"] = c.isNotNull() & ~c.isin(*f.enum)
        if isinstance(f.type, (T.DoubleType, T.FloatType)):
            rules[f"finite:{f.name}"] = F.isnan(c) | (F.abs(c) == float("inf"))
        if f.low is not None:
            rules[f"min:{f.name}"] = c < f.low
        if f.high is not None:
            rules[f"max:{f.name}"] = c > f.high
    for name, ok in contract.checks.items():
        rules[f"check:{name}"] = ~F.coalesce(F.expr(ok), F.lit(True))
    return rules


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(rule, n_rows) including primary-key repeats; rules without violations are omitted."""
    rules = row_rules(contract)
    tags = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    rows = df.select(F.explode(tags).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n_rows"))
    dup = df.groupBy(*contract.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dup = dup.agg(F.sum("n").alias("n_rows")).where("n_rows is not null").select(F.lit("primary_key").alias("rule"), "n_rows")
    return rows.unionByName(dup)


def validate(df: DataFrame, contract: Contract) -> DataFrame:
    """Return the frame when it meets the contract, else raise with the first problems."""
    problems = schema_problems(df, contract)
    if not problems:
        problems = [f"{r.rule}: {r.n_rows} rows" for r in violations(df, contract).limit(20).collect()]
    if problems:
        raise ContractError(f"{contract.name}: " + "; ".join(problems))
    return df


def write_table(df: DataFrame, contract: Contract, path: str) -> None:
    """Validate, then write zstd Parquet in contract column order."""
    validate(df, contract).select(*[f.name for f in contract.fields]).write.mode("overwrite").option("compression", "zstd").parquet(path)


def link_status(child: DataFrame, parent: DataFrame, key: str, same: dict) -> DataFrame:
    """Per child row: resolved, missing_parent, or mismatch:<column>; parents must be unique.

    ``same`` maps child columns to the parent columns they must equal.
    """
    from proofmill.operators.joins import assert_unique

    assert_unique(parent, [key], "parent")
    p = parent.select(key, *[F.col(v).alias(f"__p_{v}") for v in same.values()], F.lit(True).alias("__hit"))
    j = child.join(p, key, "left")
    status = F.when(F.col("__hit").isNull(), "missing_parent")
    for c, v in same.items():
        status = status.when(~F.col(c).eqNullSafe(F.col(f"__p_{v}")), f"mismatch:{c}")
    return j.withColumn("link_status", status.otherwise("resolved")).drop("__hit", *[f"__p_{v}" for v in same.values()])
