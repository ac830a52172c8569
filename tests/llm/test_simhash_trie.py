"""Fingerprints and trie against plain Python and all pairs."""
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from caseloom.llm import queries, simhash_trie
from caseloom.llm.tables import table
from test_duplicates import changed, prose, roots_of


def print_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(3, len(words))
    shingles = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def by_hand(rows, apart=3):
    prints = [print_by_hand(t) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= apart]
    roots = roots_of(range(len(rows)), links)
    first = {}
    for at, (i, _) in enumerate(rows):
        own = [x for x in (first.get(roots[at]), i) if x is not None]
        first[roots[at]] = min(own) if own else None
    return sorted(((i, f"{prints[at]:016x}", first[roots[at]]) for at, (i, _) in enumerate(rows)), key=repr)


def near(df, **settings):
    return sorted((tuple(x) for x in simhash_trie.near_duplicates(df, simhash_trie.Settings(**settings)).collect()), key=repr)


def corpus():
    r, rows = random.Random(8), []
    for family in range(10):
        text = prose(r, r.choice([2, 15, 60, 400]))
        rows += [(len(rows) + k, changed(r, text, r.choice([0, 0, 1, 1, 2, 6]))) for k in range(r.choice([1, 5, 25]))]
    odd = [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE  two"), (905, "É x y"), (None, "one two"),
           (None, "lone words here"), (2**60 + 1, "lone words here"), (903, "one two"), (906, "a b c d"), (907, prose(r, 70_000))]
    return rows + odd


@pytest.mark.parametrize("settings", [{}, {"unit": 4, "step": 4}, {"unit": 6, "step": 2}])
def test_against_all_pairs(docs, settings):
    rows = corpus()
    assert near(docs(rows), **settings) == by_hand(rows)


def test_families_of_close_fingerprints(spark):
    """Thousands of fingerprints within a few bits of each other: linked as all pairs are, in units of any size."""
    r = random.Random(5)
    prints = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in r.sample(range(64), r.choice([0, 1, 2, 3, 5]))) for _ in range(100)}
    prints |= {sum(1 << b for b in range(10) if k >> b & 1) for k in range(0, 1024, 3)} | {0, 2**64 - 1, 2**63}
    signed = sorted(x - 2**64 if x >> 63 else x for x in prints)
    values = np.array(signed, dtype=np.int64).view(np.uint64)
    close = [(signed[i], signed[j]) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1:]) <= 3) + i + 1]
    want = roots_of(signed, close)
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for unit in (100_000, 40):
        got = [tuple(x) for x in simhash_trie.links(frame, simhash_trie.Settings(unit=unit)).collect()]
        assert all(want[a] == want[b] for a, b in got)
        have = roots_of(signed, got)
        assert len(set(have.values())) == len(set(want.values()))


def test_dense_family_is_not_met_pair_by_pair():
    values = np.arange(1 << 14, dtype=np.uint64)
    steps = []
    shared = simhash_trie._shared
    try:
        simhash_trie._shared = lambda a, b: steps.append(len(a)) or shared(a, b)
        label = simhash_trie.self_join(values, np.array([[0, len(values), 0, len(values)]]), 3)
    finally:
        simhash_trie._shared = shared
    assert (label == 0).all() and sum(steps) < 64 * len(values)     # all pairs: 8191 a value


def test_empty_table(docs):
    assert near(docs([])) == []


def test_too_many_bits():
    with pytest.raises(ValueError):
        simhash_trie.links(None, simhash_trie.Settings(apart=4))


def test_query_against_all_pairs(spark, sf):
    rows = [(x.doc_id, x.text) for x in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert sorted((tuple(x) for x in queries.QUERIES["op11_simhash_trie"](spark, sf).collect()), key=repr) == by_hand(rows)
