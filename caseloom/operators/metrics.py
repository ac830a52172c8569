"""Model evaluation from counts. Nothing here sorts or collects the scored rows."""
from pyspark.sql import DataFrame, Window, functions as F

from caseloom.functions.numbers import mean_of_rounded, ratio
from caseloom.operators.prefix import running
from caseloom.operators.ranking import rank_bucket, rows_at


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages.

    0/0 counts as 0. The accuracy row repeats the accuracy in every column."""
    pairs = df.groupBy(actual, predicted).agg(F.count("*").alias("n"))
    hit = F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(F.lit(0))
    sides = pairs.select(F.inline(F.array(
        F.struct(F.col(actual).alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("called"), hit.cast("long").alias("hits")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("called"), F.lit(0).cast("long").alias("hits")),
    )))
    zero = F.lit(0.0)
    hits, called, support = F.sum("hits"), F.sum("called"), F.sum("support")
    classes = sides.groupBy("label").agg(
        F.coalesce(ratio(hits, called), zero).alias("precision"),
        F.coalesce(ratio(hits, support), zero).alias("recall"),
        F.coalesce(ratio(hits * 2, called + support), zero).alias("f1"),
        support.cast("double").alias("support"), hits.alias("hits"),
    )
    weight, n = F.col("support"), F.sum("support")
    accuracy = ratio(F.sum("hits"), n)
    scores = ("precision", "recall", "f1")
    summary = classes.agg(
        F.struct(F.lit("accuracy").alias("label"), *[accuracy.alias(s) for s in scores],
                 accuracy.alias("support")).alias("a"),
        F.struct(F.lit("macro avg").alias("label"), *[F.round(F.avg(s), 9).alias(s) for s in scores],
                 n.alias("support")).alias("m"),
        F.struct(F.lit("weighted avg").alias("label"),
                 *[F.round(F.sum(F.col(s) * weight) / n, 9).alias(s) for s in scores],
                 n.alias("support")).alias("w"),
    ).select(F.inline(F.array("a", "m", "w")))
    return classes.drop("hits").unionByName(summary)


def confusion_shares(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, share of the actual class), pairs that occur."""
    pairs = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n"))
    return pairs.select(
        "actual", "predicted",
        ratio(F.col("n"), F.sum("n").over(Window.partitionBy("actual"))).alias("share"),
    )


def confusion(df: DataFrame, actual: str, predicted: str, labels: list[str]) -> DataFrame:
    """Confusion matrix, one row per actual class, rows sum to 1."""
    return df.groupBy(F.col(actual).alias("actual")).agg(
        *[ratio(F.count_if(F.col(predicted) == v), F.count("*")).alias(v) for v in labels]
    )


def top_confusions(shares: DataFrame, k: int = 4) -> DataFrame:
    """The `k` largest off-diagonal shares, ties by name."""
    return (
        shares.where(F.col("actual") != F.col("predicted"))
        .orderBy(F.desc("share"), "actual", "predicted").limit(k)
    )


def automation_curve(df: DataFrame, confidence: str, correct: str, low: int = 30, high: int = 99) -> DataFrame:
    """Coverage and accuracy when only cases at or above a threshold are routed.

    Thresholds are `low`..`high` hundredths. Each row counts once, at the highest threshold it
    passes; running sums over those few rows give all thresholds. A row without a confidence passes none."""
    score = F.col(confidence)
    guess = F.floor(score * 100)
    passed = (
        F.when((guess + 1) / F.lit(100.0) <= score, guess + 1)
        .when(guess / F.lit(100.0) > score, guess - 1).otherwise(guess)
    )
    # Rows below the lowest threshold share the step before it.
    step = F.when(score.isNull(), F.lit(low - 1)).otherwise(F.greatest(F.least(passed, F.lit(high)), F.lit(low - 1)))
    bins = df.groupBy(step.cast("long").alias("step")).agg(
        F.count("*").alias("n"), F.sum(F.col(correct).cast("long")).alias("right"))
    steps = df.sparkSession.range(low - 1, high + 1).toDF("step")
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.coalesce(F.sum("n").over(above), F.lit(0))
    return steps.join(bins, "step", "left").select(
        "step", (F.col("step") / F.lit(100.0)).alias("threshold"),
        ratio(n, F.sum("n").over(Window.partitionBy())).alias("coverage"),
        ratio(F.sum("right").over(above), n).alias("accuracy"),
    ).where(F.col("step") >= low).drop("step").orderBy("threshold")


def first_threshold(curve: DataFrame, target: float = 0.95) -> DataFrame:
    """The lowest threshold whose accuracy reaches the target (no row when none does)."""
    return curve.where(F.col("accuracy") >= target).orderBy("threshold").limit(1)


def score_histogram(df: DataFrame, label: str, score: str) -> DataFrame:
    """Hits and misses per distinct score, rounded or not. Cases without a score don't count."""
    return df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum(1 - F.col(label).cast("long")).alias("neg"),
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Chance that a hit scores above a miss; ties count half."""
    big = lambda c: c.cast("decimal(38,0)")
    ranked = running(score_histogram(df, label, score), [F.col("score")], {"below": "neg"})
    wins = F.sum(big(F.col("pos").cast("decimal(19,0)") * (F.col("below") * 2 + F.col("neg")).cast("decimal(18,0)")))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double") * 2
    return ranked.agg(F.try_divide(wins.cast("double"), pairs).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Step-wise area under precision and recall (no interpolation)."""
    counted = running(score_histogram(df, label, score), [F.desc("score")], {"tp": "pos", "called": F.col("pos") + F.col("neg")})
    steps = counted.withColumns({"tp": F.col("tp") + F.col("pos"), "called": F.col("called") + F.col("pos") + F.col("neg")})
    gain = F.col("pos") * ratio(F.col("tp"), F.col("called"))
    return steps.agg(F.round(
        F.try_divide(F.sum(gain), F.sum("pos").cast("double")), 9).alias("average_precision"))


def lift_stats(df: DataFrame, label: str, score: str, key: str, bucket) -> DataFrame:
    """Capture in the top 20% of the queue, precision and lift in its top 10%.

    The last case of each is found first, then every case is compared with it: no case moves. Cases without a score
    are the end of the queue; they count, and none of them is in its top."""
    n = df.count()
    sizes = [n * 2 // 10, n // 10]
    lasts = rows_at(df, score, lambda scored: [min(size, scored) for size in sizes], key, bucket, True)
    hit, top = F.col(label).cast("long"), []
    for size, last in zip(sizes, lasts):
        s = F.col(score)
        inside = F.lit(False) if last is None else (s > F.lit(last[0])) | ((s == F.lit(last[0])) & (F.col(key) <= F.lit(last[1])))
        top.append(F.coalesce(inside, F.lit(False)))
    in20, in10 = (F.sum(F.when(t, hit)) for t in top)
    precision, base = ratio(in10, F.count_if(top[1])), ratio(F.sum(hit), F.count("*"))
    return df.agg(
        ratio(in20, F.sum(hit)).alias("capture_top20"),
        precision.alias("precision_top10"),
        F.try_divide(precision, base).alias("lift_top10"),
        base.alias("base_rate"),
    )


def model_row(df: DataFrame, name: str, label: str, score: str, key: str, bucket) -> DataFrame:
    """One line of the model comparison."""
    return lift_stats(df, label, score, key, bucket).withColumns({
        "model": F.lit(name),
        "roc_auc": roc_auc(df, label, score).scalar(),
        "average_precision": average_precision(df, label, score).scalar(),
    })


def decile_table(df: DataFrame, label: str, score: str, key: str, bucket, k: int = 10) -> DataFrame:
    """Size, rate, mean score, cumulative capture and lift of every score decile, best first."""
    counted = rank_bucket(df, score, k, key, bucket, "decile", descending=True).groupBy("decile").agg(
        F.count("*").alias("cases"), F.sum(F.col(label).cast("long")).alias("hits"),
        mean_of_rounded(score, 6).alias("avg_score"),
    )
    whole = Window.partitionBy()
    so_far = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits, cases = F.sum("hits").over(whole), F.sum("cases").over(whole)
    rate = ratio(F.col("hits"), F.col("cases"))
    return counted.select(
        "decile", "cases", rate.alias("relief_rate"), "avg_score",
        ratio(F.sum("hits").over(so_far), hits).alias("cumulative_capture"),
        F.try_divide(rate, ratio(hits, cases)).alias("lift"),
    ).orderBy("decile")
