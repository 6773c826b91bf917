"""Licence phrases by a positional index of rare words, in DataFrame functions only.

The words of the licence templates are counted over all documents.  Each template is posted under
the rarest words of its mandatory phrases, with their positions.  A file's occurrences of those words
meet the postings; template places are where all of a template's anchors agree on the relative
position, and the mandatory phrases are then compared word by word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``words`` in order; each of ``keys`` is a mandatory phrase that ``words`` contains."""

    label: str
    words: str
    keys: tuple[str, ...]
    base: bool = False

    def spans(self) -> list[tuple[int, list[str]]]:
        """(first word, words) of each mandatory phrase."""
        all_words, out = self.words.split(), []
        for key in self.keys:
            k = key.split()
            out.append((next(i for i in range(len(all_words)) if all_words[i : i + len(k)] == k), k))
        return out


#: The phrases that are always looked for.
BASE = (
    Template("gpl", "gnu general public license", ("gnu general public license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("cc-by", "cc by", ("cc by",), True),
    Template("mit", "mit license", ("mit license",), True),
)
#: Longer notices with labels of their own.
NOTICES = (
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("mit-released", "released under the mit license", ("released under the mit license",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge", "obtaining a copy of this software")),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("rights-reserved", "all rights reserved", ("all rights reserved",)),
)


def _words(text) -> F.Column:
    # the Kelvin sign is the one other character whose lower case is an ASCII letter
    plain = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("å"))
    return F.regexp_extract_all(F.lower(plain), F.lit(WORD), F.lit(0))


def _texts(words) -> F.Column:
    return F.array(*map(F.lit, words))


def postings(df_of: dict[str, int], templates, anchors: int) -> list[tuple]:
    """(word, template, position, anchors of the template): the rarest words of the mandatory phrases; none where one never occurs."""
    out = []
    for t, template in enumerate(templates):
        places = {w: first + i for first, words in template.spans() for i, w in reversed(list(enumerate(words)))}
        if all(df_of.get(w) for w in places):
            rare = sorted(places, key=lambda w: (df_of[w], places[w]))[:anchors]
            out += [(w, t, places[w], len(rare)) for w in rare]
    return out


def licence_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=BASE + NOTICES, anchors: int = 3) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): one row per row of ``docs``.

    Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased.  ``n_base`` counts the
    places of all base phrases, the two word positions are their smallest and largest start (null
    without one).  ``score`` is the largest share of a found notice's words that stand where the
    notice has them; a base phrase alone gives 0.5, nothing 0.  Null and empty texts have no words and
    no labels; repeated rows are scanned one by one; other columns are not read.

    The templates are a parameter of a few dozen entries, so the index is a literal table.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for t in templates for _, words in t.spans() for w in words})
    src = docs.select(F.col(key).cast("long").alias("doc_id"), _words(F.col(text)).alias("words"))
    counted = src.select(F.explode(F.array_intersect("words", _texts(vocabulary))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    index = postings({r["word"]: r["df"] for r in counted.collect()}, templates, anchors)  # at most one row per licence word
    rare = sorted({p[0] for p in index})
    reach = max(len(t.words.split()) for t in templates)

    place = lambda w, i: F.when(w.isin(rare), i)
    at = F.array_compact(F.transform("words", place)) if rare else F.lit(None).cast("array<int>")
    near = lambda i: F.struct(
        i.alias("pos"),
        F.element_at("words", i + 1).alias("word"),
        F.greatest(i - reach, F.lit(0)).alias("base"),
        F.slice("words", F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)).alias("near"),
    )
    rows = src.select("doc_id", F.size("words").cast("long").alias("n_words"), F.transform(at, near).alias("found"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()))
    if not index:
        hits = spark.createDataFrame([], "row long, template int, start int, share double")
    else:
        table = spark.createDataFrame(index, "word string, template int, rel int, need int")
        met = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*").join(F.broadcast(table), "word")
        met = met.withColumn("start", F.col("pos") - F.col("rel"))
        agreed = met.groupBy("row", "template", "start", "need").agg(F.count_distinct("word").alias("n"), F.min(F.struct("pos", "base", "near")).alias("c")).where("n = need")
        full = [(t, x.words.split(), [first + i for first, words in x.spans() for i in range(len(words))]) for t, x in enumerate(templates)]
        agreed = agreed.join(F.broadcast(spark.createDataFrame(full, "template int, notice array<string>, keys array<int>")), "template")
        stands = lambda i: F.coalesce(F.get("c.near", F.col("start") + i - F.col("c.base")) == F.get("notice", i), F.lit(False))
        share = F.size(F.filter(F.sequence(F.lit(0), F.size("notice") - 1), stands)) / F.size("notice")
        hits = agreed.where(F.forall("keys", stands)).select("row", "template", "start", share.alias("share"))
    hits = stage(hits)

    base = [i for i, t in enumerate(templates) if t.base]
    names = F.element_at(_texts([t.label for t in templates]), F.col("template") + 1)
    is_base = F.col("template").isin(base)
    best = F.max(F.when(is_base, F.lit(0.5)).otherwise(F.col("share")))
    joined = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    per = hits.groupBy("row").agg(
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(is_base, names)).alias("base_labels"),
        joined(names).alias("labels"),
        best.alias("score"),
    )
    out = rows.select("row", "doc_id", "n_words").join(per, "row", "left")
    fill = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return out.select("doc_id", "n_words", fill("n_base", 0), "first_word", "last_word", fill("base_labels", ""), fill("labels", ""), fill("score", 0.0))
