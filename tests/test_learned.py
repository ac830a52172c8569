"""Topics and models on planted data."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom import settings as S
from caseloom.operators import metrics as M, models, splits, topics, vocabulary as V
from caseloom.plans.lineage import cut

BLOCKS = [[f"{chr(97 + k)}word{chr(97 + i)}" for i in range(12)] for k in range(3)]
NOISE = [f"noise{chr(97 + i)}" for i in range(20)]
SEEDS = [(f"theme {k}", block[:2]) for k, block in enumerate(BLOCKS)]


def corpus(spark, n=300):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        k = rng.randrange(3)
        words = [rng.choice(BLOCKS[k]) for _ in range(10)] + [rng.choice(NOISE) for _ in range(6)]
        rng.shuffle(words)
        hit = rng.random() < (0.8 if "aworda" in words or "bwordb" in words else 0.15)
        rows.append((i, k, " ".join(words), f"p{k}", f"c{i % 9}" if i else "once", int(hit), f"t{i // 2}", i % 2))
    return spark.createDataFrame(rows, "case_id long, k int, narrative_clean string, product string, company string,"
                                 " relief int, text_group string, flag int")


@pytest.fixture(scope="module")
def data(spark):
    return cut(corpus(spark))


@pytest.fixture(scope="module")
def fitted(data):
    counts = V.term_counts(data)
    vocab = cut(V.vocabulary(counts, data, 5, 0.9, 100))
    vectors = V.case_vectors(V.tfidf(counts, vocab))
    return vocab, vectors, topics.fit_topics(vectors, vocab, SEEDS, 50, 1e-6)


def test_planted_topics_are_recovered(data, fitted):
    _, vectors, model = fitted
    out = model.assign(data, vectors).join(data, "case_id")
    assert out.count() == 300
    assert out.where("topic_id = k").count() >= 0.95 * 300
    assert all(a >= b - 1e-9 for a, b in zip(model.objective, model.objective[1:]))
    assert not any(r["drifted"] for r in model.drift(20).collect())
    for r in model.top_terms(5).collect():
        assert r["top_terms"].count(",") == 4 and set(r["top_terms"].split(", ")) & set(BLOCKS[r["topic_id"]])


def test_fit_repeats(data, fitted):
    vocab, vectors, model = fitted
    again = topics.fit_topics(vectors.repartition(5), vocab, SEEDS, 50, 1e-6)
    assert abs(again.H - model.H).max() < 1e-6


def test_a_pass_of_topics_exchanges_nothing(spark, fitted, monkeypatch):
    _, vectors, model = fitted
    plans, stored = [], cut(vectors)
    collect = type(stored).collect
    monkeypatch.setattr(type(stored), "toPandas", lambda df: plans.append(df) or pytest.fail("sums by rows"))
    monkeypatch.setattr(type(stored), "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    A, B = topics.pass_statistics(stored, model.H)
    assert len(plans) == 1 and "Exchange" not in plans[0]
    W = {r["case_id"]: r["weights"] for r in model.weights(stored).collect()}
    assert np.allclose(A, sum(np.outer(w, w) for w in W.values()))


def test_no_known_term_means_unclassified(spark, fitted):
    vocab, _, model = fitted
    odd = spark.createDataFrame([(9, "zebra quagga"), (10, "aworda awordb awordc")], "case_id long, narrative_clean string")
    out = {r["case_id"]: r for r in model.assign(odd, V.case_vectors(V.tfidf(V.term_counts(odd), vocab))).collect()}
    assert out[9]["theme"] == S.UNCLASSIFIED and out[9]["theme_strength"] == 0.0
    assert out[10]["theme"] == "theme 0" and out[10]["theme_strength"] > 0


def test_missing_anchor_fails(fitted):
    vocab, vectors, _ = fitted
    with pytest.raises(ValueError, match="zebra"):
        topics.fit_topics(vectors, vocab, [("t", ["aworda", "zebra"])])


def test_routing_recovers_the_class(data):
    train, test = data.where("case_id % 5 <> 0"), data.where("case_id % 5 = 0")
    router = models.fit_router(train, size=200, max_iter=30)
    out = cut(router.predict(test, "product"))
    report = {r["label"]: r for r in M.class_report(out, "product", "route_pred").collect()}
    assert router.labels == ["p0", "p1", "p2"]
    assert report["accuracy"]["precision"] >= 0.95 and report["macro avg"]["support"] == test.count()
    assert out.where("route_confidence < 1/3.0 OR route_confidence > 1").count() == 0


def test_rare_levels_share_a_feature_and_unseen_ones_add_nothing(spark, data):
    train = data.where("case_id < 200")
    levels = {r["level"]: r["idx"] for r in models.category_levels(train, ["company", "product"], 22).collect() if r["name"] == "company"}
    counts = {r["company"]: r["count"] for r in train.groupBy("company").count().collect()}
    rare = {c for c, n in counts.items() if n < 22}
    assert "once" in rare and len({levels[c] for c in rare}) == 1
    assert len({levels[c] for c in counts}) == len(counts) - len(rare) + 1
    design = models.fit_design(train, ("company", "product"), ("flag",), 50, min_rows=22)
    new = data.limit(1).select("case_id", "narrative_clean", "flag", F.lit("never").alias("company"), F.lit("p1").alias("product"))
    parts = design.parts(new)
    assert len(parts.first()["fields"]) == 1
    vector = design.features(parts, "both").first()["features"]
    assert vector.size == design.n_levels + 1 + design.n_terms


OPTIONS = {"categories": ("company", "product"), "numbers": ("flag",), "size": 100, "min_rows": 5}


def test_fold_encoders_equal_a_fit_on_the_other_folds(data):
    folded = cut(splits.group_folds(data, "text_group", 3, 42))
    for fold, design in models.fold_designs(folded, 3, **OPTIONS):
        direct = models.fit_design(folded.where(F.col("fold") != fold), **OPTIONS)
        assert design.levels.exceptAll(direct.levels).count() == 0 == direct.levels.exceptAll(design.levels).count()
        assert design.vocab.exceptAll(direct.vocab).count() == 0 == direct.vocab.exceptAll(design.vocab).count()
        assert (design.n_levels, design.n_terms) == (direct.n_levels, direct.n_terms)


def test_outcome_beats_the_base_rate_and_folds_never_leak(data, monkeypatch):
    seen = []
    original = models.fit_outcome

    def spy(design, parts, *args, **options):
        seen.append({r["text_group"] for r in parts.join(data, "case_id").select("text_group").distinct().collect()})
        return original(design, parts, *args, **options)

    monkeypatch.setattr(models, "fit_outcome", spy)
    scores = cut(models.out_of_fold(data, 3, max_iter=20, **OPTIONS))
    assert scores.count() == scores.select("case_id").distinct().count() == 300
    groups = {r["text_group"] for r in data.select("text_group").distinct().collect()}
    tests = [groups - s for s in seen]
    assert len(seen) == 3 and set.union(*tests) == groups and sum(map(len, tests)) == len(groups)
    auc = M.roc_auc(scores.join(data, "case_id"), "relief", "relief_score").first()["roc_auc"]
    assert auc > 0.65


def test_a_null_category_is_a_level(spark):
    rows = [(i, None if i % 2 else "a", "word text", 0) for i in range(10)]
    df = spark.createDataFrame(rows, "case_id long, product string, narrative_clean string, flag int")
    design = models.fit_design(df, ("product",), ("flag",), 10, min_df=1, max_df=1.0, min_rows=1)
    fields = {r["case_id"]: r["fields"] for r in design.parts(df).collect()}
    assert all(len(x) == 1 for x in fields.values()) and fields[0] != fields[1] == fields[3]


def test_term_table_holds_what_term_counts_gives(spark, data):
    odd = spark.createDataFrame([(900, ""), (901, "one"), (902, "b a b a b")], "case_id long, narrative_clean string")
    df = data.select("case_id", "narrative_clean").unionByName(odd)
    table = V.term_table(df)
    assert table.count() == df.count()
    got, want = V.counts_of(table), V.term_counts(df)
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_fits_run_to_their_optimum_without_python(data, monkeypatch):
    router = models.fit_router(data, size=200)
    out = router.predict(data, "product")
    text = out._jdf.queryExecution().executedPlan().toString()
    assert not any(node in text for node in ("EvalPython", "MapInPandas", "PythonUDF"))
    optimum = router.optima[0]
    assert optimum.left <= models.OPTIMAL and optimum.passes < models.PASSES
    assert all(abs(n - p) < 0.1 for n, p in zip(optimum.counts, optimum.predicted)) and sum(optimum.counts) == 300
    monkeypatch.setattr(models, "PASSES", 2)
    with pytest.raises(RuntimeError, match="gradient"):
        models.fit_router(data, size=200)


@pytest.mark.parametrize("k", [1, 3])
def test_sums_of_a_pass_against_whole_matrices(spark, k, monkeypatch):
    monkeypatch.setattr(models, "ENTRIES", 4)       # rows come in several parts, one of them without entries
    rows = [(i % max(k, 2), [j for j in range(5) if (i + j) % 3 and i != 4], i) for i in range(9)]
    df = spark.createDataFrame([(y, at, [1.0 + 0.1 * i + j for j in at]) for y, at, i in rows], "label int, indices array<int>, values array<double>")
    x = np.zeros((9, 6))
    x[:, 5] = 1.0
    for _, at, i in rows:
        x[i, at] = [1.0 + 0.1 * i + j for j in at]
    rng = np.random.default_rng(3)
    w, v, y = rng.normal(size=(k, 6)) / 9, rng.normal(size=(k, 6)), np.array([r[0] for r in rows])
    m, u = x @ w.T, x @ v.T
    p = np.exp(m) / np.exp(m).sum(1, keepdims=True) if k > 1 else 1 / (1 + np.exp(-m))
    hit = y[:, None] == (np.arange(k) if k > 1 else 1)
    found = models.pass_sums(df, w)
    assert np.allclose(found["slope"], (p - hit).T @ x) and np.allclose(found["chances"], p.sum(0))
    assert np.allclose(found["loss"], -np.log(np.where(hit, p, 1 - p if k == 1 else 1.0)).sum())
    bent = p * (u - (p * u).sum(1, keepdims=True)) if k > 1 else p * (1 - p) * u
    assert np.allclose(models.pass_sums(df, w, v)["slope"], bent.T @ x)


def test_a_fit_of_one_class_foretells_it(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1)], "label double, at int")
    data = models.stored_vectors(df.select("label", models.sparse(3, F.array("at"), F.array(F.lit(1.0))).alias("features")))
    optima = []
    model = models.fit_regression(data, 1.0, "binomial", optima=optima)
    assert [r["prediction"] for r in model.transform(data).collect()] == [1.0, 1.0] and optima[0].counts == [0, 2]
