"""Feature columns: interactions, hashed n-grams, quality control, layer merge."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.functions.text import clean


def interactions(df: DataFrame, terms) -> DataFrame:
    """Add product columns for (left, right, absolute, name)."""
    new = {}
    for a, b, absolute, name in terms:
        p = F.col(a) * F.col(b)
        new[name] = F.abs(p) if absolute else p
    return df.withColumns(new)


#: Hashes of n-grams that a task remembers, as texts share most of theirs.
KNOWN_GRAMS = 1 << 18


def hashed_ngrams(df: DataFrame, text: str, out: str = "bits", low: int = 2, high: int = 4, n_bits: int = 1024) -> DataFrame:
    """Sorted distinct hashed character n-grams of the whole text (a binary fingerprint; MD5, so any engine gives the same bits)."""

    @F.pandas_udf("array<int>")
    def bits(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}

        def one(t: str) -> list[int]:
            if len(known) > KNOWN_GRAMS:
                known.clear()
            grams = {t[i : i + n] for n in range(low, high + 1) for i in range(len(t) - n + 1)}
            for g in grams.difference(known):
                known[g] = int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % n_bits
            return sorted({known[g] for g in grams})

        for batch in texts:
            yield batch.map(one)

    return df.withColumn(out, bits(clean(text)))


def word_set(df: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    """Sorted distinct lower-case words of the whole text."""
    words = F.array_distinct(F.split(F.trim(F.lower(clean(text))), r"\s+"))
    return df.withColumn(out, F.array_sort(F.filter(words, lambda w: w != "")))
