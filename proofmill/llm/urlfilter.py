"""URL verdicts: the longest fitting host and path rule, else a weighted vocabulary over host and path."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import ascii_lower

STRICT, SOFT = 2, 1
#: Terms that decide alone, by subject: gambling, pornography, drugs, fraud and malware, piracy.
STRICT_TERMS = (
    "casino casinos roulette blackjack sportsbook betway slotmachine slotmachines "
    "porn porno pornhub pornography xxx hentai camgirl camgirls milf escort escorts nsfw "
    "viagra cialis levitra xanax tramadol oxycontin steroids "
    "spam spammer phishing malware ransomware botnet keylogger carding cvv scam "
    "warez keygen crackz torrentz nulled"
)
#: Terms that decide with another one.  Single letters are ratings.
SOFT_TERMS = (
    "bet bets betting gamble gambling jackpot jackpots lottery lotto poker slot slots win winner winners wager odds spin spins "
    "adult adults sex sexy nude nudes naked erotic fetish dating hookup singles cam cams webcam x xx 18plus "
    "pill pills pharmacy pharma meds prescription diet weightloss slimming supplement supplements cbd kratom "
    "cheap discount deal deals bargain coupon coupons promo promos bonus bonuses free freebie gratis prize prizes giveaway reward rewards "
    "loan loans credit payday mortgage refinance debt cash money earn income rich millionaire crypto bitcoin forex binary investment "
    "ad ads adserver banner banners click clicks popup popups track tracker trackers tracking pixel affiliate affiliates traffic seo backlink backlinks "
    "crack cracked serial serials torrent torrents mp3 stream streams download downloads "
    "replica replicas fake counterfeit rolex essay essays followers likes farm farms clickbait viral"
)


def weighted(strict: str, soft: str) -> dict[str, int]:
    """Term -> weight: a strict term weighs as much as the limit, a soft one 1."""
    return {**dict.fromkeys(soft.split(), SOFT), **dict.fromkeys(strict.split(), STRICT)}


VOCABULARY = weighted(STRICT_TERMS, SOFT_TERMS)
LIMIT = 2

#: Fixed values: (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def split_url(url) -> tuple[F.Column, F.Column]:
    """(host, path): what follows the first ``://``; both empty where there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(host, path, rules) -> F.Column:
    """The longest rule whose host is the url's or a parent of it and whose path begins the url's: (rule, verdict)."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _count(vocabulary: dict[str, int], limit: int):
    def run(batches):
        machine = ahocorasick.Automaton()
        for term, weight in vocabulary.items():
            machine.add_word(term, (term, weight))
        machine.make_automaton()
        inside = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        for batch in batches:
            strict, soft = [], []
            for text in batch.column(batch.schema.get_field_index("judged")).to_pylist():
                hits = set()
                for end, (term, weight) in machine.iter(text):
                    start = end - len(term)
                    if (start < 0 or text[start] not in inside) and (end + 1 == len(text) or text[end + 1] not in inside):
                        hits.add((term, weight))
                strict.append(sum(w >= limit for _, w in hits))
                soft.append(sum(w < limit for _, w in hits))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(strict, pa.int64()), pa.array(soft, pa.int64())], [*batch.schema.names, "n_strict", "n_soft"])

    return run


def vocabulary_of(table: DataFrame, term: str = "term", weight: str = "weight", most: int = 100_000) -> dict[str, int]:
    """A vocabulary from a table of terms and weights (lower-case terms; the largest weight of a repeated term), at most ``most`` terms."""
    rows = table.where(F.col(term).isNotNull() & F.col(weight).isNotNull() & (F.col(term) != "")).groupBy(F.col(term).alias("t")).agg(F.max(weight).alias("w")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    return {r["t"]: int(r["w"]) for r in rows}


def url_verdicts(pages: DataFrame, rules=RULES, vocabulary=None, limit: int = LIMIT, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft): one row per row of ``pages``.

    Where a rule fits, the longest decides.  Else terms of the vocabulary are looked up in the
    lower-cased host and path, standing between characters other than a-z and 0-9 or the ends; one
    term of weight ``limit`` or more, or ``limit`` distinct softer ones, block the url.  A null url and
    one without ``://`` have an empty host and path, so no rule and no term fits and they are allowed.
    Repeated rows are judged alike; other columns are not read.
    """
    host, path = split_url(F.col(url).cast("string"))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("judged", F.concat("host", ascii_lower(F.col("path"))))
    kind = dict(rows.dtypes)["page_id"]
    out = rows.mapInArrow(_count(dict(vocabulary or VOCABULARY), limit), f"page_id {kind}, host string, path string, judged string, n_strict long, n_soft long")
    out = out.withColumn("r", best_rule(F.col("host"), F.col("path"), rules))
    own = F.when((F.col("n_strict") > 0) | (F.col("n_soft") >= limit), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), "n_strict", "n_soft")
