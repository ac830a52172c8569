"""What the star, the topics and the fits no longer move or write."""
import threading

import numpy as np
from pyspark.sql import functions as F

from caseloom.operators import copies, models
from checks import learned, star

SF = "/root/testdata/sf0.001"


def test_whole_cases_move_once(spark, monkeypatch):
    """Copies are marked on narrow rows, and ids move as bytes and come back as they were."""
    marked, joined, mark, enrich = [], [], star.with_copies, star.star.enrich
    monkeypatch.setattr(star, "with_copies", lambda df: marked.append(df.columns) or mark(df))
    monkeypatch.setattr(star.star, "enrich", lambda *frames: joined.extend(f.schema for f in frames[:3]) or enrich(*frames))
    _, full = star.parts(spark, SF)
    assert len(marked) == 1 and "issue" not in marked[0] and "company" not in marked[0]
    assert [s["case_id"].dataType.simpleString() for s in joined] == ["binary"] * 3
    ids = full.select("case_id", "dup_count", "is_duplicate_text")
    assert ids.where(F.col("case_id").rlike("^[0-9a-f]{32}$") & (F.col("is_duplicate_text") == (F.col("dup_count") > 1).cast("int"))).count() == ids.count() > 0


def test_terms_of_topics_are_not_moved_to_find_first_texts(spark, monkeypatch):
    seen, plain = [], copies.first_per_group
    monkeypatch.setattr(copies, "first_per_group", lambda df, *a: seen.append(df.columns) or plain(df, *a))
    rows = [(i, text, group, 5) for i, (text, group) in enumerate([("aa bb cc dd ee", "x"), ("aa bb cc dd ee", "x"), ("ff gg hh ii jj", "y")])] + [(3, "aa", "z", 1)]
    monkeypatch.setattr(learned, "cases_text", lambda *_: spark.createDataFrame(
        rows, "case_id long, narrative_clean string, text_group string, narrative_words int"))
    fitted = []
    monkeypatch.setattr(learned.V, "vocabulary", lambda counts, docs, *_: fitted.append(docs) or spark.createDataFrame([("aa", 0, 1.0)], "term string, idx int, idf double"))
    monkeypatch.setattr(learned.topics, "fit_topics", lambda *_: None)
    terms = learned.topic_fit(spark, SF)[0]
    assert seen == [["case_id", "text_group"]]
    assert sorted(r["case_id"] for r in fitted[0].collect()) == [0, 2] and terms.count() == 4


def test_fits_run_side_by_side_and_keep_their_order(monkeypatch):
    together = threading.Barrier(models.FITS, timeout=20)

    def fit(name, own):
        together.wait()
        own.append(f"optimum {name}")
        return name

    optima = []
    names = list(range(models.FITS))
    assert models.side_by_side(fit, names, optima) == names and optima == [f"optimum {n}" for n in names]


def test_packed_rows_give_the_sums_of_plain_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "ENTRIES", 7)
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(3)), sorted(map(int, rng.choice(9, size=int(n), replace=False)))) for n in rng.integers(0, 6, 20)]
    df = spark.createDataFrame([(y, at, [1.0 + j for j in at], 9) for y, at in rows], "label int, indices array<int>, values array<double>, size int")
    packed = models.packed_rows(df)
    held = packed.select(F.size("label").alias("n"), (F.length("at") / 4).alias("entries"), "size").collect()
    assert sum(r["n"] for r in held) == 20 and sum(r["entries"] for r in held) == sum(len(at) for _, at in rows) and {r["size"] for r in held} == {9}
    w, v = rng.normal(size=(3, 10)), rng.normal(size=(3, 10))
    for along in (None, v):
        one, other = models.pass_sums(packed, w, along), models.pass_sums(df, w, along)
        assert all(np.allclose(one[name], other[name]) for name in one)
    data = df.select("label", models.sparse(9, F.col("indices"), F.col("values")).alias("features"))
    plain, stored = (models.fit_regression(x, 1.0, "multinomial").coefficientMatrix.toArray() for x in (data, models.stored_vectors(data)))
    assert np.allclose(plain, stored, atol=1e-3)
