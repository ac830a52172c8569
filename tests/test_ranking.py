"""Global ranks, quantile buckets, skew-proof lookups, splits."""
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from caseloom.operators import copies, ranking as K, skew, splits


@pytest.mark.parametrize("n, k, sizes", [
    (117214, 5, [23443, 23443, 23442, 23443, 23443]),
    (23098, 10, [2310, 2310, 2310, 2309, 2310, 2310, 2309, 2310, 2310, 2310]),
    (1, 5, [1]),
    (3, 5, [1, 1, 1]),
])
def test_published_bucket_sizes(spark, n, k, sizes):
    ranks = spark.range(1, n + 1).select(K.quantile_bucket(F.col("id"), F.lit(n), k).alias("b"))
    assert [r["count"] for r in ranks.groupBy("b").count().orderBy("b").collect()] == sizes


@pytest.mark.parametrize("descending", [False, True])
def test_rank_with_a_hot_score(spark, descending):
    rng = random.Random(1)
    rows = [(i, 0 if rng.random() < 0.4 else rng.randrange(-50, 50)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "case_id long, score int")
    got = K.global_rank(df, "score", "case_id", K.id_bucket("case_id", 64), descending).collect()
    want = sorted(rows, key=lambda r: (-r[1] if descending else r[1], r[0]))
    assert {r["case_id"]: r["rank"] for r in got} == {c: i + 1 for i, (c, _) in enumerate(want)}
    assert {r["ranked"] for r in got} == {3000}


def test_buckets_agree_with_pandas(spark):
    rows = [(i, (i * 7919) % 997) for i in range(1234)]
    df = spark.createDataFrame(rows, "case_id long, score int")
    got = K.rank_bucket(df, "score", 10, "case_id", K.id_bucket("case_id", 100), "b").toPandas().set_index("case_id")["b"]
    frame = pd.DataFrame(rows, columns=["case_id", "score"]).set_index("case_id")
    want = pd.qcut(frame["score"].rank(method="first"), 10, labels=False) + 1
    assert (got.sort_index() == want.sort_index()).all()


def test_top_categories_break_ties_by_name(spark):
    df = spark.createDataFrame([(c,) for c in "bbaaccd"] + [(None,)], "company string")
    out = K.fold_to_top(df, "company", 2, "rest", "g").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in out} == {"a": 2, "b": 2, "rest": 4}


def test_heavy_and_light_keys_get_the_same_answer(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 400}") for i in range(3000)] + [(5000, None)]
    df = spark.createDataFrame(rows, "case_id long, key string")
    lookup = df.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))
    got = skew.attach_by_key(df, lookup, "key", "n", "case_id", heavy_share=10)
    want = df.join(lookup, "key", "left").select("case_id", "key", "n")
    assert got.count() == 3001
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    plain = skew.look_up(df, lookup, "key", "n", "case_id", max_rows=5)   # too many rows to broadcast
    assert plain.select("case_id", "key", "n").exceptAll(want).count() == 0


@pytest.mark.parametrize("hot", ["hot", None])
def test_rows_of_a_heavy_key_are_spread(spark, hot):
    rows = [(i, hot) for i in range(2000)] + [(9000 + i, f"k{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "case_id long, key string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = skew.attach_by_key(df, df.groupBy("key").agg(F.count("*").alias("n")), "key", "n", "case_id")
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 2050 and max(sizes) < 2 * 2050 / 8


def test_copies(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, ""), (5, "")], "case_id long, text_group string")
    marked = {r["case_id"]: (r["dup_count"], r["is_duplicate_text"]) for r in copies.mark_copies(df).collect()}
    assert marked == {1: (2, 1), 3: (2, 1), 2: (1, 0), 4: (2, 1), 5: (2, 1)}
    assert sorted(r["case_id"] for r in copies.first_per_group(df).collect()) == [1, 2, 4]


def grouped(spark, n=2000):
    return spark.range(n).select(F.col("id").alias("case_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 301).alias("g"))


def test_holdout_keeps_groups_whole(spark):
    out = splits.group_holdout(grouped(spark), "g", 0.2, 42)
    per_group = out.groupBy("g").agg(F.min("in_holdout").alias("a"), F.max("in_holdout").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in per_group)
    assert sum(r["a"] for r in per_group) == -(-len(per_group) // 5)
    again = splits.group_holdout(grouped(spark).repartition(7), "g", 0.2, 42)
    assert out.exceptAll(again).count() == 0
    other = splits.group_holdout(grouped(spark), "g", 0.2, 43)
    assert out.exceptAll(other).count() > 0


@pytest.mark.parametrize("k", [2, 5, 7])
def test_folds_are_even_in_groups(spark, k):
    out = splits.group_folds(grouped(spark), "g", k, 1)
    folds = out.select("g", "fold").distinct().groupBy("fold").count().collect()
    assert out.select("g", "fold").distinct().count() == out.select("g").distinct().count()
    sizes = [r["count"] for r in folds]
    assert len(sizes) == k and max(sizes) - min(sizes) <= 1


def test_more_folds_than_groups(spark):
    out = splits.group_folds(spark.createDataFrame([(1, "a"), (2, "b")], "case_id long, g string"), "g", 5, 1)
    assert out.select("fold").distinct().count() == 2


def test_rows_without_a_score_stay_and_do_not_count(spark):
    rows = [(i, None if i % 3 == 0 else i % 7) for i in range(100)] + [(200 + i, 3) for i in range(90)]
    df = spark.createDataFrame(rows, "case_id long, score int")
    for descending in (False, True):
        got = {r.case_id: r.b for r in K.rank_bucket(df, "score", 10, "case_id", K.id_bucket("case_id", 8), "b", descending).collect()}
        ranked = sorted((i for i, s in rows if s is not None), key=lambda i: ((-1) ** descending * dict(rows)[i], i))
        n = len(ranked)
        want = {i: max(1, -(-(at * 10) // (n - 1))) for at, i in enumerate(ranked)}
        assert got == {i: want.get(i) for i, _ in rows}
    empty = df.where("score IS NULL")
    assert {r.b for r in K.rank_bucket(empty, "score", 10, "case_id", K.id_bucket("case_id", 8), "b").collect()} == {None}


def test_cases_without_a_confidence_pass_no_threshold(spark):
    from caseloom.operators.metrics import automation_curve

    df = spark.createDataFrame([(None, 1), (None, 1), (0.995, 1), (0.5, 0)], "confidence double, correct int")
    curve = {round(r.threshold, 2): (r.coverage, r.accuracy) for r in automation_curve(df, "confidence", "correct").collect()}
    assert curve[0.99] == (0.25, 1.0) and curve[0.3] == (0.5, 0.5)


def test_rows_without_a_group_are_one_group(spark):
    from caseloom.operators.splits import group_folds, group_holdout

    df = spark.createDataFrame([(None,), (None,), ("a",), ("b",), ("b",)], "g string")
    assert all(group_holdout(df, "g", 0.3, seed).groupBy("in_holdout").count().count() == 2 for seed in range(4))
    folds = group_folds(df, "g", 3, 1).distinct().collect()
    assert sorted(r.fold for r in folds) == [0, 1, 2]


def test_packed_columns_hold_more_places_than_four_bits(spark):
    from caseloom.operators import star

    rows = [(i, f"p{i % 20}", f"t{i % 3}", "c", f"2020-{i % 40:02}", 0, 0, 1, 0, 1, 0, 1, 0, 2, 1, 0) for i in range(80)]
    df = spark.createDataFrame(rows, "case_id int, product string, theme string, company_group string, month string, in_metro int, in_region int, relief int, "
                               "monetary_relief int, timely int, in_holdout int, is_duplicate_text int, older_american int, tone_quintile int, relief_priority_decile int, servicemember int")
    names = {(r.name, r.place): r.value for r in star.dictionaries(df).collect()}
    for r in star.packed(df, ()).collect():
        assert names["product", r.b0 & 31] == f"p{r.case_id % 20}" and r.b0 >> 7 & 1 == 1
        assert names["month", r.b2 >> 4] == f"2020-{r.case_id % 40:02}" and names["theme", r.b1 & 31] == f"t{r.case_id % 3}"


@pytest.mark.parametrize("odd", [[1e300], [float("inf"), float("-inf")], [1e12, -1e12, 5e-324]])
def test_outliers_do_not_fill_one_bin(spark, monkeypatch, odd):
    monkeypatch.setattr(K, "CELL_ROWS", 50)
    rng = random.Random(4)
    rows = [(i, rng.choice([0.25, rng.random()])) for i in range(2000)] + [(5000 + i, s) for i, s in enumerate(odd)] + [(9000, None)]
    df = spark.createDataFrame(rows, "case_id long, score double")
    for descending in (False, True):
        ranked = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1] if descending else r[1], r[0]))
        places = [1, 2, 700, 1000, 1001, len(ranked)]
        got = K.rows_at(df, "score", lambda n: [0, *places], "case_id", K.id_bucket("case_id", 100), descending)
        assert got == [None, *[(ranked[p - 1][1], ranked[p - 1][0]) for p in places]]


def test_whole_numbers_beyond_doubles(spark, monkeypatch):
    monkeypatch.setattr(K, "CELL_ROWS", 3)
    rows = [(i, 2**60 + i % 7) for i in range(40)]
    got = K.rows_at(spark.createDataFrame(rows, "case_id long, score long"), "score", lambda n: [9, 30], "case_id", K.id_bucket("case_id", 4), False)
    ranked = sorted(rows, key=lambda r: (r[1], r[0]))
    assert got == [(ranked[8][1], ranked[8][0]), (ranked[29][1], ranked[29][0])]


def test_lift_with_null_scores_at_the_end(spark):
    from caseloom.operators.metrics import lift_stats

    rows = [(i, None if i % 4 == 0 else (i * 37) % 11 / 10, int(i % 3 == 0)) for i in range(100)]
    got = lift_stats(spark.createDataFrame(rows, "case_id long, score double, hit int"), "hit", "score", "case_id", K.id_bucket("case_id", 16)).first()
    queue = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    hits = sum(r[2] for r in rows)
    assert got.capture_top20 == sum(r[2] for r in queue[:20]) / hits and got.base_rate == hits / 100
    assert got.precision_top10 == sum(r[2] for r in queue[:10]) / 10


@pytest.mark.parametrize("ranges", [1, 7])
def test_running_sums(spark, ranges):
    from caseloom.operators.prefix import numbered, running

    rng = random.Random(9)
    rows = [(i, rng.randrange(50), None if i % 9 == 0 else rng.randrange(100)) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, g int, x int").repartition(ranges)
    got = {r["id"]: (r["before"], r["seen"]) for r in running(df, [F.desc("g"), F.asc("id")], {"before": "x", "seen": F.lit(1)}).collect()}
    want, total = {}, 0
    for seen, (i, _, x) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))):
        want[i] = total, seen
        total += x or 0
    assert got == want
    assert numbered(df.limit(0), [F.col("id")], "n").count() == 0


def test_a_key_below_the_share_is_dealt_by_its_rows(spark):
    """Ten keys of 300 rows: none has a tenth of all rows, but each has three times what a task takes."""
    rows = [(i, f"k{i % 10}") for i in range(3000)]
    df = spark.createDataFrame(rows, "case_id long, key string")
    lookup = df.groupBy("key").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = skew.attach_by_key(df, lookup, "key", "n", "case_id", heavy_share=2, task_rows=100)
        per_task = out.groupBy("key", F.spark_partition_id().alias("p")).count().collect()
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sum(r["count"] for r in per_task) == 3000 and {r["n"] for r in out.collect()} == {300}
    assert sum(r["count"] > 250 for r in per_task) <= 2         # salts may share a task by chance
