"""Sums over all earlier rows of a global order, without a window on one task."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.plans.lineage import cut


def running(df: DataFrame, order: list[Column], sums: dict[str, str | Column]) -> DataFrame:
    """Add for each name the sum of its column over the rows before, the own row left out; 0 for the first.

    `order` must tell all rows apart. Rows are sorted by range and written; a window runs inside each range, and what
    the ranges before it add up to, one row a range, is carried in. The order of equal-sized ranges is the sort order, so
    no task sees more than its own range."""
    own = {f"_own_{name}": (F.col(c) if isinstance(c, str) else c) for name, c in sums.items()}
    ranged = cut(df.withColumns(own).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = sorted(ranged.groupBy("_range").agg(*[F.sum(c).alias(c) for c in own]).collect())     # one row a range
    carried, before = [], [0] * len(own)
    for at, *total in totals:
        carried.append((at, *before))
        before = [b + (t or 0) for b, t in zip(before, total)]
    types = ranged.agg(*[F.sum(c).alias(c) for c in own]).schema
    carry = df.sparkSession.createDataFrame(
        [(at, *[None if b == 0 else b for b in row]) for at, *row in carried],
        "_carry_range int, " + ", ".join(f"_carry{f.name} {f.dataType.simpleString()}" for f in types))
    earlier = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sized = ranged.join(F.broadcast(carry), F.col("_range") == F.col("_carry_range"))
    return sized.select(*df.columns, *[
        (zero(F.sum(f"_own_{name}").over(earlier)) + zero(F.col(f"_carry_own_{name}"))).alias(name) for name in sums])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add `name`: 0, 1, 2, ... in a global order that tells all rows apart."""
    return running(df, order, {name: F.lit(1)})
