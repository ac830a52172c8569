"""Quality voting and toxic passages on planted words."""
import random

import numpy as np
import pytest

from caseloom.llm import quality_knn, toxicity
from caseloom.llm.tables import held_out


def corpus(n=600, seed=3):
    """(rows, quality, toxic): junk rows carry symbols, toxic rows a run of words of their own."""
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "st", "ra", "lo")]
    rows, quality, toxic = [], {}, {}
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(30, 120))]
        quality[i], toxic[i] = int(i % 5 != 0), int(i % 4 == 0)
        if toxic[i]:
            at = r.randint(0, len(text) - 1)
            text[at:at] = [r.choice(["vex", "vile", "vamp"]) for _ in range(4)]
        if not quality[i]:
            text = [w + "###" for w in text]
        rows.append((i, " ".join(text)))
    return rows, quality, toxic


ODD = [(9001, None), (9002, ""), (9003, "###"), (9003, "###"), (None, "ban ban"), (9004, "ban vex " * 20_000)]


@pytest.fixture
def labelled(spark):
    def make(labels):
        return spark.createDataFrame(sorted(labels.items()) + [(None, 1)], "doc_id long, mark int")
    return make


def held(spark, rows):
    return {r.doc_id for r in spark.createDataFrame([(i,) for i, _ in rows], "doc_id long").where(held_out()).collect()}


def accuracy(scores, truth, ids, least):
    return np.mean([(scores[i] >= least) == truth[i] for i in ids])


def test_held_out_quality(spark, docs, labelled):
    rows, quality, _ = corpus()
    model = quality_knn.fit(docs(rows), labelled(quality), "mark", quality_knn.Settings(sample=300))
    assert len(model.labels) == 300
    got = [(r.doc_id, r.score) for r in quality_knn.scores(docs(rows + ODD), model).collect()]
    assert len(got) == len(rows) + len(ODD) and all(0 <= s <= 1 for _, s in got)
    assert accuracy(dict(got), quality, held(spark, rows), 0.3) > 0.97
    prior = model.labels.mean()
    assert dict(got)[9001] == dict(got)[9002] == pytest.approx(prior)
    assert len({s for i, s in got if i == 9003}) == 1


def test_votes_against_plain_cosines():
    r = np.random.default_rng(1)
    vectors = quality_knn.unit(r.standard_normal((40, 5)).astype(np.float32))
    vectors[7] = vectors[8]
    labels = r.integers(0, 2, 40).astype(float)
    model = quality_knn.Model(np.ones(quality_knn.WORDS + quality_knn.SHAPES, np.float32),
                              r.standard_normal((quality_knn.WORDS + quality_knn.SHAPES, 5)).astype(np.float32), vectors, labels,
                              quality_knn.Settings(neighbours=6))
    counts = r.integers(0, 3, (4, quality_knn.WORDS + quality_knn.SHAPES)).astype(np.float32)
    z = quality_knn.unit(quality_knn.weighted(counts, model.idf) @ model.axes)
    for row, score in zip(z, model.score(counts)):
        cos = vectors @ row
        near = [i for i in range(40) if cos[i] >= sorted(cos)[-6]]
        w = np.array([max(cos[i], 0.0) ** 4 for i in near], dtype=float)
        assert score == pytest.approx((w * labels[near]).sum() / w.sum(), rel=1e-4)


def test_labels_of_held_out_rows_are_not_learnt(spark, docs, labelled):
    rows, quality, toxic = corpus(200)
    out = held(spark, rows)
    flipped = {i: 1 - q if i in out else q for i, q in quality.items()}
    a, b = (quality_knn.fit(docs(rows), labelled(x), "mark") for x in (quality, flipped))
    assert np.array_equal(a.labels, b.labels) and np.array_equal(a.vectors, b.vectors)
    flipped = {i: 1 - q if i in out else q for i, q in toxic.items()}
    a, b = (toxicity.fit(docs(rows), labelled(x), "mark") for x in (toxic, flipped))
    assert np.array_equal(a.weights, b.weights) and (a.slope, a.offset) == (b.slope, b.offset)


def test_without_labels_or_rows(docs, labelled):
    rows = [(1, "a b"), (2, None)]
    assert quality_knn.fit(docs(rows), labelled({}), "mark") is None and toxicity.fit(docs(rows), labelled({}), "mark") is None
    assert [r.score for r in quality_knn.scores(docs(rows), None).collect()] == [0.5, 0.5]
    assert [r.score for r in toxicity.passages(docs(rows), None).collect()] == [0.0, 0.0]
    assert quality_knn.scores(docs([]), None).count() == toxicity.passages(docs([]), None).count() == 0
    assert toxicity.fit(docs([]), labelled({1: 1, 2: 0}), "mark") is None


def test_held_out_toxicity_and_its_passages(spark, docs, labelled):
    rows, _, toxic = corpus()
    model = toxicity.fit(docs(rows), labelled(toxic), "mark")
    got = [r for r in toxicity.passages(docs(rows + ODD), model).collect()]
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert accuracy(scores, toxic, held(spark, rows), 0.5) > 0.95
    assert scores[9001] == scores[9002] < 0.5
    text = dict(rows)
    hit = [r for r in got if r.doc_id in text and toxic[r.doc_id] and r.passages]
    assert len(hit) > 100
    for r in hit:
        words = text[r.doc_id].replace("###", " ").split()
        p = max(r.passages, key=lambda p: p.score)
        assert all(w in ("vex", "vile", "vamp") for w in (words[p.start], words[p.end - 1]))


def slow_segments(x):
    """Maximal segments by their definition: take the best run, then go on left and right of it."""
    out = []

    def go(low, high):
        best = max(((sum(x[a:b]), -(b - a), -a, a, b) for a in range(low, high) for b in range(a + 1, high + 1)), default=None)
        if best and best[0] > 0:
            a, b = best[3:]
            out.append((a, b, best[0]))
            go(low, a)
            go(b, high)
    go(0, len(x))
    return sorted(out)


def test_maximal_segments_against_their_definition():
    r = random.Random(7)
    for _ in range(300):
        x = [r.choice([-3.25, -2, -1.5, -0.75, 1, 1.375, 2.625, 3.0625]) for _ in range(r.randint(0, 14))]
        got = sorted((a, b, round(s, 6)) for a, b, s in toxicity.segments(np.array(x)))
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in slow_segments(x)))
        assert [round(s, 6) for *_, s in got] == [round(s, 6) for *_, s in slow_segments(x)] or len(got) == len(slow_segments(x))


def test_chance_rate_solves_its_equation():
    w, p = np.array([-1.0, 2.0, -0.5]), np.array([0.6, 0.1, 0.3])
    assert (p * np.exp(toxicity.chance_rate(w, p) * w)).sum() == pytest.approx(1.0, abs=1e-6)
    assert toxicity.chance_rate(np.array([-1.0]), np.array([1.0])) == 1.0
