"""Exact global ranks without a window over all rows."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.functions.numbers import whole_div


def id_bucket(key: str, width: int = 65536) -> Column:
    """Order-keeping bucket of a unique, non-negative whole-number id: `width` rows at most."""
    return whole_div(F.col(key), F.lit(width))


def prefix_bucket(key: str, length: int = 2) -> Column:
    """Order-keeping bucket of a hash written in hex: 16 ** length even buckets."""
    return F.substring(F.col(key), 1, length)


def global_rank(df: DataFrame, score: str, key: str, bucket: Column, descending: bool = False) -> DataFrame:
    """Add `rank` (1..n, ties of `score` by `key`) and `ranked` (n).

    `score` must have a bounded number of values (round it first); `key` is unique and `bucket`
    rises with it. Offsets come from counts per (score, bucket); rows are numbered only inside
    their own (score, bucket) cell, so a score shared by a third of all rows is still spread
    over all buckets. The one window without a partition runs over the distinct scores. Rows without a score are ranked
    where Spark sorts nulls: first in rising order, last in falling order."""
    ordered = F.col(score).desc() if descending else F.col(score).asc()
    rows = df.withColumn("_bucket", bucket)
    cells = rows.groupBy(score, "_bucket").agg(F.count("*").alias("_n"))
    by_score = (
        cells.groupBy(F.col(score).alias("_score")).agg(F.sum("_n").alias("_score_n"))
        .select(
            "_score",
            (F.sum("_score_n").over(Window.orderBy(
                F.col("_score").desc() if descending else F.col("_score").asc()
            ).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_score_n")).alias("_before"),
            F.sum("_score_n").over(Window.partitionBy()).alias("ranked"),
        )
    )
    inside = Window.partitionBy(score).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cells.withColumn("_earlier", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(by_score, F.col(score).eqNullSafe(F.col("_score")))
        .select(
            F.col(score).alias("_offset_score"), F.col("_bucket").alias("_offset_bucket"),
            (F.col("_before") + F.col("_earlier")).alias("_offset"), "ranked",
        )
    )
    cell = Window.partitionBy(score, "_bucket").orderBy(key)
    return (
        rows.withColumn("_place", F.row_number().over(cell))
        .join(
            offsets,
            F.col(score).eqNullSafe(F.col("_offset_score")) & F.col("_bucket").eqNullSafe(F.col("_offset_bucket")),
        )
        .select(*df.columns, (F.col("_offset") + F.col("_place")).alias("rank"), "ranked")
    )


def quantile_bucket(rank: Column, n: Column, k: int) -> Column:
    """Bucket 1..k of a rank when edges sit at 1 + (n-1) * j / k and belong to the lower bucket.

    Not ntile: the surplus rows land in other buckets."""
    place = whole_div((rank - 1) * k + n - 2, n - 1)
    return F.coalesce(F.greatest(F.lit(1), place), F.lit(1)).cast("int")


BINS = 4096
CELL_ROWS = 100_000      # rows of a bin that are sorted by cells
LARGEST = 1.7976931348623157e308


def rows_at(df: DataFrame, score: str, places, key: str, bucket: Column, descending: bool) -> list[tuple | None]:
    """(score, key) of the rows at some places, counted from 1, in the order of (score, key); null scores have no place.

    `places` is a function of the number of rows with a score. Rows are counted in even bins between the least and the greatest
    score; a bin that holds a place and more than `CELL_ROWS` rows is parted again between its own least and greatest
    score, so outliers cost a pass each time they are cut off, not a bin with all rows. What is left is counted by (score, bucket
    of the key), and the cells with a place are numbered. The driver sees BINS counts a place, and the rows found. A place
    below 1 gives None."""
    rows = df.where(F.col(score).isNotNull()).select(F.col(score).alias("s"), F.col(key).alias("key"), bucket.alias("b"))
    value = F.greatest(F.least(F.col("s").cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))     # infinite scores share the outer bins
    rows = rows.withColumn("o", -value if descending else value)
    low, high, n = rows.agg(F.min("o"), F.max("o"), F.count("*")).first()
    wanted = places(n)
    open_ = {j: (low, high, place, n) for j, place in enumerate(wanted) if place >= 1}
    done: dict[int, tuple] = {}
    while open_:
        done |= {j: r for j, r in open_.items() if r[3] <= CELL_ROWS or _width(*r[:2]) <= 0}
        open_ = {j: r for j, r in open_.items() if j not in done}
        if not open_:
            break
        ranges = sorted({r[:2] for r in open_.values()})
        inside, bin_ = F.lit(None).cast("int"), F.lit(None).cast("double")
        for i, (lo, hi) in enumerate(ranges):
            here, width = F.col("o").between(lo, hi), _width(lo, hi)
            inside = F.when(here, i).otherwise(inside)
            bin_ = F.when(here, F.floor(F.col("o") / width - lo / width).cast("double")).otherwise(bin_)
        counts = rows.select("o", inside.alias("i"), bin_.alias("bin")).where("i IS NOT NULL").groupBy("i", "bin").agg(
            F.count("*").alias("n"), F.min("o").alias("low"), F.max("o").alias("high")).orderBy("i", "low").collect()
        for j, (lo, hi, place, held) in open_.items():
            before = 0
            for c in (c for c in counts if ranges[c["i"]] == (lo, hi)):
                if before < place <= before + c["n"]:
                    same = c["n"] == held and (c["low"], c["high"]) == (lo, hi)     # no double lies between
                    open_[j] = (c["low"], c["high"], place - before, 0 if same else c["n"])
                    break
                before += c["n"]
    if not done:
        return [None for _ in wanted]
    ranges = sorted({r[:2] for r in done.values()})
    inside = F.array_compact(F.array(*[F.when(F.col("o").between(lo, hi), F.lit(i)) for i, (lo, hi) in enumerate(ranges)]))   # ranges may overlap
    cuts = df.sparkSession.createDataFrame([(j, ranges.index(r[:2]), r[2]) for j, r in done.items()], "cut int, bin int, place long")
    order = [F.desc("s") if descending else F.asc("s"), F.asc("b")]
    upto = Window.partitionBy("bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = rows.withColumn("bin", F.explode(inside))
    cells = held.groupBy("bin", "s", "b").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(upto))
    found = cells.join(F.broadcast(cuts), "bin").where("place <= upto AND place > upto - n").select(
        "cut", F.col("bin").alias("cut_bin"), F.col("s").alias("cut_s"), F.col("b").alias("cut_b"),
        (F.col("place") - F.col("upto") + F.col("n")).alias("inside"))
    same = (F.col("bin") == F.col("cut_bin")) & (F.col("s") == F.col("cut_s")) & F.col("b").eqNullSafe(F.col("cut_b"))
    numbered = held.join(F.broadcast(found), same).withColumn("at", F.row_number().over(Window.partitionBy("cut").orderBy("key")))
    rows_found = {r["cut"]: (r["s"], r["key"]) for r in numbered.where("at = inside").select("cut", "s", "key").collect()}
    return [rows_found.get(j) for j in range(len(wanted))]


def _width(low: float, high: float) -> float:
    return high / BINS - low / BINS


def last_rows(df: DataFrame, score: str, k: int, key: str, bucket: Column, descending: bool) -> list[tuple]:
    """(score, key) of the last row of buckets 1..k-1 in the order of (score, key); null scores have no place."""
    ends = lambda n: [j * (n - 1) // k + 1 for j in range(1, k)] if n else []
    return rows_at(df, score, ends, key, bucket, descending)


def rank_bucket(df: DataFrame, score: str, k: int, key: str, bucket: Column, name: str,
                descending: bool = False) -> DataFrame:
    """Add the quantile bucket `name` (1..k) of the global rank of `score`, ties by `key`.

    The cuts are found when this is called; then each row is compared with k - 1 constants, so no row moves.
    Rows without a score stay, with a null bucket, and don't count."""
    s, own = F.col(score), F.col(key)
    place = F.lit(1)
    for at, last in last_rows(df, score, k, key, bucket, descending):
        beyond = s < F.lit(at) if descending else s > F.lit(at)
        place = place + (beyond | ((s == F.lit(at)) & (own > F.lit(last)))).cast("int")
    return df.withColumn(name, F.when(s.isNotNull(), place))


def top_categories(df: DataFrame, column: str, n: int) -> DataFrame:
    """The `n` most frequent values (ties by name) and their counts."""
    return (
        df.groupBy(column).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc(column)).limit(n)
    )


def fold_to_top(df: DataFrame, column: str, n: int, other: str, name: str) -> DataFrame:
    """Add `name`: the value itself when it is among the `n` most frequent, else `other`.

    The broadcast side has `n` rows by construction."""
    top = top_categories(df.where(F.col(column).isNotNull()), column, n).select(F.col(column).alias("_top"))
    joined = df.join(F.broadcast(top), F.col(column) == F.col("_top"), "left")
    return joined.withColumn(name, F.coalesce("_top", F.lit(other))).drop("_top")


def ordered_categories(df: DataFrame, column: str, last: str | None = None) -> DataFrame:
    """Distinct values with their place (0, 1, ...) by falling count, ties by name; `last` goes
    to the end. The window runs over the distinct values."""
    at_end = (F.col(column) == last) if last is not None else F.lit(False)
    order = Window.orderBy(F.col("_end"), F.desc("n"), F.asc(column))
    return (
        df.groupBy(column).agg(F.count("*").alias("n"))
        .withColumn("_end", at_end)
        .withColumn("place", (F.row_number().over(order) - 1).cast("int")).drop("_end")
    )
