import random

import pytest

CLASH = "size long, shard int, digest string, bands string, words string, row long, score double, label string, part int, token string, n_words long, __row long, __digest string, __key string, __score double"


def prose(seed: int, n: int, syllables=("an", "the", "re", "on", "Ti", "ou", "é", "st", "3", "ing")) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


def edited(text: str, at: int) -> str:
    words = text.split(" ")
    words[at] = "changed"
    return " ".join(words)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, ties, copies, near copies and repeated rows."""
    base, other = prose(1, 120), prose(2, 200)
    rows = [(i, prose(100 + i, 30 + i)) for i in range(10, 16)]
    rows += [(1, base), (2, base), (3, edited(base, 60)), (4, base.replace(" ", "\n\t ")), (5, base.upper()), (6, other), (6, other), (7, edited(other, 5))]
    rows += [(8, None), (9, ""), (20, " \n "), (None, "loose words here"), (None, None), (21, "two words"), (22, "two words"), (23, "one"), (24, prose(3, 30000)), (25, "\x1c\x85 \x0b\x0c é́ Σσς 'S don't   x  "), (26, "…‽ 日本語 テキスト")]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    extra = [7, 7, "x", "x", "x", 7, 7.0, "x", 7, "x", 7, 7, "x", "x", 7.0]
    return spark.createDataFrame([(*r, *extra) for r in edge_rows], f"doc_id long, text string, {CLASH}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
