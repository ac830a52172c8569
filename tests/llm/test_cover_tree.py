"""Hard negatives against every pair."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import cover_tree, queries

SCHEMA = "embedding array<float>, label int, vec_id long, vector string, score long, query int, cell string"


@pytest.fixture
def rows(spark):
    def make(rows):
        return spark.createDataFrame([(v, label, i, "v", 1, 2, "c") for i, label, v in rows], SCHEMA)
    return make


def by_hand(rows, step=100):
    used = {(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, label, v in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in used:
        if i % step:
            continue
        scored = sorted({(-dot(v, w), j, m == label) for j, m, w in used if j != i})
        for s, j, _ in [x for x in scored if x[2]][:5]:
            inside = [(-t, k) for t, k, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, rank, k, -s, t) for rank, (t, k) in enumerate(inside, 1)]
    return sorted(out)


def mined(frame, step=100, **settings):
    used = cover_tree.usable(frame)
    used = used.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return sorted(tuple(x) for x in cover_tree.hard_negatives(used, F.col("vec_id") % step == 0, cover_tree.Settings(**settings)).collect())


def corpus(seed, n=700, width=6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, width))
    out = []
    for i in range(n):
        v = centres[r.integers(5)] + r.choice([0.0, 0.02, 0.5]) * r.normal(size=width)
        out.append((i, int(r.integers(0, 3)), np.round(v, 1 if i % 3 else 4).tolist()))
    hot = [(1000 + i, int(i % 2), out[0][2]) for i in range(400)]                        # one vector many times
    odd = [(2000, None, [1.0] * width), (2100, 1, None), (2200, 1, [1.0, None] + [0.0] * (width - 2)), (2300, 1, [float("nan")] * width),
           (2400, 1, [float("inf")] * width), (None, 1, [1.0] * width), (2500, 2, [0.0] * width), (2600, 2, [2.0, 1.0]), (2700, 1, []),
           (2701, 1, [0.5] * (width + 3)), (300, 1, [0.1] * width), (2800, 9, [-3.0] * width)]
    return out + hot + odd + out[:120]


@pytest.mark.parametrize("settings", [{}, {"leaf": 4, "block": 3, "shrink": 0.6, "sample": 50, "cells": 5}])
def test_against_every_pair(rows, settings):
    data = corpus(3)
    assert mined(rows(data), **settings) == by_hand(data)


def test_small_batches(spark, rows):
    data = corpus(4, 300, 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        assert mined(rows(data), 10) == by_hand(data, 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_large_components(rows):
    data = [(i, i % 2, [float((i * 7919) % 1000) * 1e3, float(i), -1e6]) for i in range(0, 400)]
    assert mined(rows(data)) == by_hand(data)


def test_nothing_to_mine(rows):
    assert mined(rows([])) == [] == mined(rows([(1, 1, [1.0]), (2, 1, [1.0])]))


def test_nodes_outside_the_window_are_skipped():
    """On clustered vectors the search scores a small part of all pairs, and finds what scoring all of them finds."""
    r = np.random.default_rng(6)
    points = (256 * (r.normal(size=(40, 16))[r.integers(0, 40, 8000)] + 0.02 * r.normal(size=(8000, 16)))).astype(np.int64)
    labels, ids = r.integers(0, 3, 8000), np.arange(8000)
    some = np.arange(0, 8000, 400)
    top = (points[some].astype(float) ** 2).sum(axis=1).astype(np.int64)
    best = cover_tree.Best(points[some], ids[some], labels[some], (top * 8 // 10)[:, None], top[:, None], False, 5)
    best.search(cover_tree.CoverTree(points, 32, 0.85), ids, labels)
    assert best.seen < 0.2 * len(some) * len(points)
    scores = points[some] @ points.T
    for row, i in enumerate(some):
        want = sorted((-s, j) for j, s in enumerate(scores[row]) if labels[j] != labels[i] and top[row] * 8 // 10 <= s <= top[row])[:5]
        got = [(-s, j) for s, j in zip(best.score[row, 0], best.id[row, 0]) if s != cover_tree.LOWEST]
        assert got == want


def test_tree_covers_its_points():
    points = np.random.default_rng(2).integers(-200, 200, size=(900, 5))
    tree = cover_tree.CoverTree(points, 10, 0.8)
    for at, (low, high, centre, radius) in enumerate(tree.nodes):
        assert (tree.apart(tree.order[low:high], centre) <= radius + 1e-9).all()
        for child in tree.below.get(at, ()):
            assert tree.nodes[child][3] <= 0.8 * radius + 1e-9
    assert sorted(tree.order) == list(range(900))


def test_query_against_every_pair(spark, sf):
    data = [tuple(x) for x in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    assert sorted(tuple(x) for x in queries.QUERIES["op12_hard_negatives"](spark, sf).collect()) == by_hand(data)
