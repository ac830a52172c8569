"""Terms and phrases of a case, counted inside tasks, against the column expressions; phrases that share a hash."""
import random

import pytest
from pyspark.sql import functions as F

from caseloom.functions import text as X
from caseloom.operators import phrases, vocabulary as V

STOP = ("the", "of")


def texts(seed):
    r = random.Random(seed)
    bits = ["the", "of", "a", "pay", "loan", "don't", "é", "", "'", "xx", "pay loan", "loans"]
    return [None, "", "a", "the of"] + [" ".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(60)]


@pytest.mark.parametrize("n,held", [(1, 100_000), (2, 100_000), (2, 5)])
def test_term_table_against_the_expressions(spark, monkeypatch, n, held):
    monkeypatch.setattr(V, "TABLE_TERMS", held)
    df = spark.createDataFrame([(i, t, f"c{i}") for i, t in enumerate(texts(n))], "case_id long, narrative_clean string, fold string")
    made = V.term_table(df, stop=STOP, n=n, carry=("fold",))
    got = {r.case_id: (r.fold, [tuple(t) for t in r.terms]) for r in made.collect()}
    grams = V.counted(X.ngrams(X.tokens(F.col("narrative_clean"), STOP), n))
    want = {r.case_id: (r.fold, [tuple(t) for t in r.terms]) for r in df.select("case_id", "fold", grams.alias("terms")).collect()}
    assert got == want and len(got) == df.count()


@pytest.mark.parametrize("held", [100_000, 5])
def test_phrases_against_the_expressions(spark, monkeypatch, held):
    monkeypatch.setattr(phrases, "TASK_PHRASES", held)
    rows = [(p, None, i % 2, 0, t) for i, t in enumerate(texts(7)) for p in ("x",)]
    df = spark.createDataFrame(rows, "product string, company string, relief int, is_duplicate_text int, narrative_clean string")
    got = sorted(tuple(sorted(r.phrases)) for r in phrases.case_phrases(df, STOP).collect())
    want = X.ngrams(X.tokens(F.col("narrative_clean"), STOP))
    assert got == sorted(tuple(sorted(set(r.p or ()))) for r in df.select(want.alias("p")).collect())


def test_phrases_are_counted_by_hash_and_rare_ones_stay_out(spark, monkeypatch):
    monkeypatch.setattr(phrases.F, "xxhash64", lambda c: F.length(c))      # every length is one hash
    rows = [("x" if i % 2 else "y", f"c{i}", i % 3 == 0, 0, "pay loan" if i else "pay late") for i in range(8)]
    df = spark.createDataFrame([(a, b, int(c), d, e) for a, b, c, d, e in rows], "product string, company string, relief int, is_duplicate_text int, narrative_clean string")
    got = {r.phrase: r.cases for r in phrases.phrase_gaps(df, 2, max_company=1.0, vague=()).collect()}
    assert got == {"pay": 8, "loan": 7, "pay loan": 7}
