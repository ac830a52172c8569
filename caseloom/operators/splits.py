"""Seeded splits that never part the copies of a text.

Groups are put in the order of a seeded hash, and a split is a run of groups in that order. A
row finds its side by comparing its own hash with the cut hashes, so no join on the group is
needed however many rows share one."""
from pyspark.sql import Column, DataFrame, Window, functions as F

PREFIX = 4   # hex digits: 65,536 even counting cells


def seeded_hash(group: str, seed: int) -> Column:
    """Rows without a group are one group, whose hash no other group has."""
    return F.coalesce(F.md5(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string"))), F.md5(F.lit(f"{seed}")))


def cut_hashes(df: DataFrame, group: str, seed: int, places: Column) -> Column:
    """Sorted array (a scalar subquery) of the hashes found at the given 1-based places.

    `places` is an array built from `groups`, the number of distinct groups. Groups are counted
    per hash prefix; only the prefixes that hold a cut are numbered, a 65,536th of the groups
    each."""
    hashes = df.select(seeded_hash(group, seed).alias("hash")).distinct().withColumn(
        "prefix", F.substring("hash", 1, PREFIX))
    upto = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = hashes.groupBy("prefix").agg(F.count("*").alias("n"))
    cells = counts.select(
        F.col("prefix").alias("cut_prefix"), F.col("n"), F.sum("n").over(upto).alias("upto"),
        F.sum("n").over(Window.partitionBy()).alias("groups"),
    ).withColumn("wanted", F.filter(
        places, lambda p: (p <= F.col("upto")) & (p > F.col("upto") - F.col("n"))
    )).where(F.size("wanted") > 0)
    inside = Window.partitionBy("prefix").orderBy("hash")
    found = (
        hashes.join(cells, F.col("prefix") == F.col("cut_prefix"))
        .withColumn("place", F.col("upto") - F.col("n") + F.row_number().over(inside))
        .where(F.array_contains("wanted", F.col("place")))
    )
    return found.agg(F.sort_array(F.collect_list("hash"))).scalar()


def group_holdout(df: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """`in_holdout` = 1 for the share of groups (rounded up) that comes first in hash order."""
    last = F.ceil(F.col("groups") * F.lit(share)).cast("long")
    cut = cut_hashes(df, group, seed, F.array(last))
    return df.withColumn("in_holdout", (seeded_hash(group, seed) <= cut[0]).cast("int"))


def group_folds(df: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """`fold` 0..k-1: runs of groups in hash order, sizes differing by one at most."""
    small = F.call_function("div", F.col("groups"), F.lit(k))
    extra = F.col("groups") % k
    ends = [small * (i + 1) + F.least(extra, F.lit(i + 1)) for i in range(k - 1)]
    cuts = cut_hashes(df, group, seed, F.array(*[e.cast("long") for e in ends]))
    own = seeded_hash(group, seed)
    return df.withColumn("fold", sum(
        (F.coalesce(own > F.get(cuts, F.lit(i)), F.lit(False)).cast("int") for i in range(k - 1)), F.lit(0)))
