"""The pipeline's near copies against all pairs at a similarity of 80 %."""
import itertools
import random

import corpus_pipeline
from test_duplicates import prose, roots_of, shingles


def test_near_copies_from_80_percent(spark, sf, docs):
    r, rows = random.Random(31), []
    for family in range(8):
        words = prose(r, 200).split(" ")
        rows.append((len(rows), " ".join(words)))
        for n in (4, 5):                               # 0.815 and 0.77 alike
            other = list(words)
            for at in range(n):
                other[20 + 40 * at if n == 4 else 20 + 35 * at] = f"new{family}x{n}x{at}"
            rows.append((len(rows), " ".join(other)))
    sets = {i: shingles(t) for i, t in rows}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2)}
    roots = roots_of(sets, [pair for pair, x in alike.items() if x >= 0.8])
    assert any(0.8 <= x < 0.85 for x in alike.values()) and len(set(roots.values())) > 8
    got = corpus_pipeline.near_copies(spark, docs(rows), sf)
    assert {x.doc_id for x in got.collect()} == set(roots.values())
