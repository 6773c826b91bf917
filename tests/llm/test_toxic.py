import random
import zlib

import numpy as np
import pytest

from proofmill.llm.toxic import ToxicModel, bayes_factor, decay_rate, learn_toxicity, maximal_segments, sum_p_value, toxic_passages, toxicity_scores
from tests.llm.conftest import prose


def all_maximal(values):
    """Maximal segments by their definition: the best segment, then left and right of it."""
    best = None
    for i in range(len(values)):
        for j in range(i, len(values)):
            key = (round(sum(values[i : j + 1]), 9), -(j - i))
            if key[0] > 0 and (best is None or key > best[0]):
                best = (key, i, j)
    if best is None:
        return []
    (total, _), i, j = best
    left = all_maximal(values[:i])
    return left + [(i, j, total)] + [(a + j + 1, b + j + 1, s) for a, b, s in all_maximal(values[j + 1 :])]


def test_segments_by_definition():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(0, 14)
        hit = [i for i in range(n) if r.random() < 0.4]
        gains = [r.choice([0.4, 1.3, 2.7, 5.1]) + r.random() / 97 for _ in hit]
        values = [-0.37] * n
        for i, g in zip(hit, gains):
            values[i] += g
        got = [(a, b, round(s, 9)) for a, b, s in maximal_segments(np.array(hit, np.int64), np.array(gains), 0.37)]
        assert got == [(a, b, round(s, 9)) for a, b, s in all_maximal(values)]


def test_many_hits_take_linear_time():
    n = 300_000
    gains = np.where(np.arange(n) % 3 == 0, 0.2, 0.05)
    found = maximal_segments(np.arange(n), gains, 0.1)
    assert found and all(s > 0 for _, _, s in found)


def test_extreme_values():
    chances, gains = np.array([0.01, 0.002]), np.array([1.5, 4.0])
    x = decay_rate(chances, gains, 0.1)
    assert abs((chances * np.exp(x * (gains - 0.1))).sum() + 0.988 * np.exp(-0.1 * x) - 1) < 1e-6
    assert sum_p_value([6.0]) == pytest.approx(0.5 * np.exp(-6))
    assert sum_p_value([6.0, 6.0]) < sum_p_value([6.0]) < sum_p_value([3.0])


def test_bayes_factor():
    assert bayes_factor(1.0) == bayes_factor(0.4) == 1.0
    p, x = 1e-3, (np.arange(100_000) + 0.5) / 100_000
    assert bayes_factor(p) == pytest.approx((x * p ** (x - 1)).mean(), rel=1e-4)
    assert bayes_factor(0.0) > 1e200


INSULTS = ("grubnik", "vlorp")


@pytest.fixture(scope="module")
def forum(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(700):
        words = prose(i, 30 + i % 60).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice([*INSULTS, "zwirgel" + r.choice(["an", "o", "im", "ux", "eth", "ing"])]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(800 + i, rows[0][1]) for i in range(30)]  # copies of one toxic text
    labels += [(800 + i, 1) for i in range(30)] + [(5, 1), (None, 1), (6, None), (99999, 1)]
    rows += [(900, None), (901, ""), (902, "…"), (None, rows[4][1]), (None, "just words"), (903, "clean " * 40000 + "grubnik vlorp grubnik"), (7, rows[7][1])]
    docs = spark.createDataFrame([(*x, "s", 0.5, 1, 2) for x in rows], "doc_id long, text string, score string, held_out double, predicted int, key int").repartition(3)
    return docs, spark.createDataFrame([(*x, "e") for x in labels], "doc_id long, toxic int, text string"), {i for i, _ in labels if i is not None}


def test_scores(forum):
    docs, labels, truth = forum
    model = learn_toxicity(docs, labels)
    got = toxicity_scores(docs, model).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id < 700]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
        if r.doc_id in (900, 901, 902):
            assert r.score == pytest.approx(model.prior)
    (long,) = [r for r in got if r.doc_id == 903]
    assert long.predicted == 1  # found at the very end of a long text
    assert sorted(r.predicted for r in got if r.doc_id is None) == [0, 1]
    assert len({r.score for r in got if r.doc_id == 7}) == 1


def test_passages(forum):
    docs, labels, _ = forum
    model = learn_toxicity(docs, labels)
    (r,) = [r for r in toxic_passages(docs.where("doc_id = 903"), model).collect()]
    assert (r.first_word, r.last_word, r.passage) == (40000, 40002, "grubnik vlorp grubnik")
    assert r.expectation <= 0.1


def test_hits_by_plain_loops(forum):
    docs, labels, _ = forum
    model = learn_toxicity(docs, labels)
    text = "Grubnik zwirgelbo, zwirgeling the"
    raw = np.frombuffer(text.encode(), np.uint8)
    ((n, found, (starts, ends)),) = model.passages(raw, np.array([0, len(raw)]))
    words, gains = model.hits(raw, starts, ends)
    assert n == 4 and words.tolist()[:1] == [0] and {1, 2} <= set(words.tolist())
    total = sum(gains) - model.drift * (max(words) + 1)
    assert len(found) == 1 and found[0][2] == pytest.approx(total)


def test_nothing_to_learn(forum, spark):
    docs, labels, _ = forum
    for known, share in ((labels.limit(0), 0.5), (labels.where("toxic = 1"), 1.0), (labels.where("toxic = 0"), 0.0)):
        model = learn_toxicity(docs, known)
        assert not len(model.tokens) and model.prior == share
        assert {r.score for r in toxicity_scores(docs.limit(5), model).collect()} == {share}
    assert toxicity_scores(docs.limit(0), ToxicModel(np.zeros(0, np.uint64), np.zeros(0))).count() == 0
