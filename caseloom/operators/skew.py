"""Key lookups that stay even when one key holds a large part of the rows."""
from pyspark.sql import DataFrame, functions as F

# Rows of one key that a task takes on in a lookup, and the share of all rows that is as many.
TASK_ROWS = 200_000
HEAVY_SHARE = 1000
SALTS = 4096


def attach_by_key(rows: DataFrame, lookup: DataFrame, key: str, weight: str, spread: str,
                  heavy_share: int = HEAVY_SHARE, task_rows: int = TASK_ROWS) -> DataFrame:
    """Left join of `rows` with `lookup`, a written table that has one row per key.

    `weight` is the number of rows that carry the key. A key is dealt to as many tasks as its weight asks for: its lookup row is
    repeated ceil(weight / limit) times, and its rows are spread over these by a hash of `spread` (any unique
    column). The limit is `task_rows`, or a `heavy_share`-th of all rows if that is less, so the broadcast (key, times) of keys
    beyond it has total / limit rows at most. Rows without a key match nothing and are spread too. Nothing is dropped."""
    values = [c for c in lookup.columns if c != key]
    total = lookup.agg(F.sum(weight)).first()[0] or 0
    limit = max(1, min(task_rows, total // heavy_share))
    times = F.ceil(F.col(weight) / limit).cast("int")
    heavy = lookup.where(F.col(key).isNotNull() & (times > 1)).select(F.col(key).alias("_heavy_key"), times.alias("_times"))
    salted = lookup.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.struct(*values).alias("_value"), F.explode(F.sequence(F.lit(0), F.greatest(times, F.lit(1)) - 1)).alias("_at"))
    dealt = rows.join(F.broadcast(heavy), F.col(key) == F.col("_heavy_key"), "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread), F.when(F.col(key).isNull(), SALTS).otherwise(F.coalesce("_times", F.lit(1)))).cast("int"))
    joined = dealt.join(salted, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_at")), "left")
    return joined.select(*rows.columns, *[F.col("_value")[c].alias(c) for c in values])


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting: beyond `max_rows` the join stays a shuffle join.

    The count stops at max_rows + 1 rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def look_up(rows: DataFrame, lookup: DataFrame, key: str, weight: str, spread: str,
            max_rows: int = 1_000_000) -> DataFrame:
    """Left join with a written or checkpointed lookup: broadcast up to `max_rows` rows, and
    `attach_by_key` beyond that."""
    if lookup.limit(max_rows + 1).count() <= max_rows:
        return rows.join(F.broadcast(lookup), key, "left")
    return attach_by_key(rows, lookup, key, weight, spread)
