"""Ordered rule tables compiled to first-match-wins expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmill.functions.text import clean


def any_term(text: Column, terms) -> Column:
    """True when the lower-cased text holds any of the literal terms."""
    return F.lower(text).rlike("|".join(re.escape(t) for t in terms))


@dataclass(frozen=True)
class Rule:
    """One row of a rule table: optional code set, optional kind set, optional text pattern."""

    label: str
    codes: tuple = ()
    kinds: tuple = ()
    pattern: str = ""
    any_of: bool = False  # True: one satisfied condition is enough

    def condition(self, code: Column, kind: Column, text: Column) -> Column:
        tests = []
        if self.codes:
            tests.append(code.isin(*self.codes))
        if self.kinds:
            tests.append(kind.isin(*self.kinds))
        if self.pattern:
            tests.append(text.rlike(self.pattern))
        out = tests[0]
        for t in tests[1:]:
            out = (out | t) if self.any_of else (out & t)
        return out


def classify(rules, *, code="", kind="", text="", default="unclassified") -> Column:
    """Label of the first rule that holds for (code, kind, text)."""
    c = F.upper(clean(code)) if code != "" else F.lit("")
    k = clean(kind) if kind != "" else F.lit("")
    t = F.lower(clean(text)) if text != "" else F.lit("")
    chain = None
    for rule in rules:
        cond = rule.condition(c, k, t)
        chain = F.when(cond, rule.label) if chain is None else chain.when(cond, rule.label)
    return chain.otherwise(default)


def classify_struct(rules, fields, *, kind, text) -> Column:
    """Like :func:`classify`, but each rule carries a tuple of output fields plus its rule name.

    ``rules``: sequence of (kinds, pattern or '', values) with values matching ``fields``.
    """
    k = F.regexp_replace(F.lower(clean(kind)), "[^a-z0-9]+", "")
    t = F.lower(clean(text))
    chain = None
    for kinds, pattern, values in rules:
        cond = k.isin(*kinds) if kinds else F.lit(True)
        if pattern:
            cond = cond & t.rlike(pattern)
        out = F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, values)])
        chain = F.when(cond, out) if chain is None else chain.when(cond, out)
    return chain.otherwise(F.struct(*[F.lit("").alias(f) for f in fields]))


def first_term(text, terms) -> Column:
    """First of the ordered terms contained in the text, '' when none is."""
    t = F.lower(clean(text))
    return F.coalesce(*[F.when(t.contains(x), F.lit(x)) for x in terms], F.lit(""))


def first_pattern(text, patterns) -> Column:
    """Label of the first (pattern, label) that matches, '' when none does."""
    t = F.lower(clean(text))
    return F.coalesce(*[F.when(t.rlike(p), F.lit(label)) for p, label in patterns], F.lit(""))


def any_listed(text, ids, separators: str = r"[;,|\s]+") -> Column:
    """Whether a separated list holds one of the ids, case aside."""
    parts = F.split(F.lower(clean(text)), separators)
    return F.arrays_overlap(parts, F.array(*[F.lit(i.lower()) for i in ids]))


def first_verdict(rules, fields) -> Column:
    """Struct of the first rule that holds; ``rules``: ordered (condition, values for ``fields``), the last condition None."""
    out = None
    for condition, values in reversed(list(rules)):
        row = F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, values)])
        out = row if condition is None else F.when(condition, row).otherwise(out)
    return out
