"""Query registry: each entry pairs a Spark builder with the SQL that must give the same rows."""

from __future__ import annotations

import re

QUERIES: dict = {}
SQL: dict = {}
VIEWS: dict = {}  # name -> SQL text; referenced as @name inside other SQL


def query(name: str, sql: str | None = None):
    def deco(fn):
        from proofmill.plans.bindings import Tables

        def run(spark, sf_dir):
            return fn(Tables(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return deco


def expand(sql: str) -> str:
    """Replace @view references by parenthesised sub-queries, innermost last."""
    for _ in range(12):
        found = re.findall(r"@(\w+)", sql)
        if not found:
            return sql.strip()
        for name in set(found):
            sql = re.sub(rf"@{name}\b", lambda m: f"({VIEWS[name].strip()})", sql)
    raise ValueError("views nest too deeply")
