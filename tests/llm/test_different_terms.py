"""Different terms of a text against its terms one by one, and counts handed on in parts."""
import random

import pytest

from caseloom.llm import pii

BITS = ["a", "Zé", "STRASSE", "ß", "İ", "ª", "µ", "²", "1", "_", " ", "\n", "\xa0", "\x85", "-", "é", "É", "日本", "Σ", "x@y.de", "10.0.0.1", "ab", "abc", "́"]


@pytest.mark.parametrize("seed", range(4))
def test_different_terms_against_terms(seed):
    r = random.Random(seed)
    for _ in range(2000):
        bits = r.sample(BITS, r.randint(1, len(BITS)))
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 30)))
        for letters in (1, 3):
            settings = pii.Settings(letters=letters)
            assert pii.different_terms(text, settings) == {t for t, _, _ in pii.terms(text, pii.base_spans(text), settings)}, text


@pytest.mark.parametrize("held", [1, 7, 200_000])
def test_counts_handed_on_in_parts(spark, docs, monkeypatch, held):
    monkeypatch.setattr(pii, "HELD", held)
    rows = [(i, f"common word number{'abcdefg'[i % 7]}") for i in range(30)] + [(None, None), (40, "")]
    df = docs(rows)
    copies = df.selectExpr("xxhash64(text) AS same").groupBy("same").count().withColumnRenamed("count", "n").where("n > 1")
    got = {r.term: r.texts for r in pii.counts(df, copies, None, pii.Settings()).collect()}
    assert got == {"common": 7, "word": 7, **{f"number{c}": 1 for c in "abcdefg"}}
