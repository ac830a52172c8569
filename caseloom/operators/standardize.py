"""Direct standardization: a group's rate against the rate its mix of strata predicts.

`baseline` says which rate of a stratum counts as normal for group g:

inner     rows outside g; a stratum that lies wholly inside g leaves all columns, counts too
outside   rows outside g; such a stratum has no expectation, the other strata carry the weight
fallback  rows outside g; such a stratum falls back to its overall rate
national  all rows of the stratum, g included
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.functions.numbers import ratio

BASELINES = ("inner", "outside", "fallback", "national")
# Sums of fractions depend on the order rows arrive in; nine decimals are the same every time.
DIGITS = 9


def group_cells(df: DataFrame, groups: list[str], stratum: str, outcome: str) -> DataFrame:
    """Counts per (group, stratum). Everything else works on these few rows."""
    return df.groupBy(*groups, stratum).agg(
        F.count("*").alias("n"), F.sum(outcome).cast("long").alias("hits")
    )


def stratum_totals(df: DataFrame, stratum: str, outcome: str) -> DataFrame:
    """Counts per stratum over all rows."""
    return df.groupBy(F.col(stratum).alias("_stratum")).agg(
        F.count("*").alias("all_n"), F.sum(outcome).cast("long").alias("all_hits")
    )


def with_cell_totals(cells: DataFrame, stratum: str) -> DataFrame:
    """The same from cells, when every row is in exactly one group. The window runs over cells,
    so the rows behind them are read once."""
    over = Window.partitionBy(stratum)
    return cells.withColumns({"all_n": F.sum("n").over(over), "all_hits": F.sum("hits").over(over)})


def baseline_rate(baseline: str) -> Column:
    """Expected rate of one (group, stratum) cell; null when it has none."""
    if baseline not in BASELINES:
        raise ValueError(f"baseline must be one of {BASELINES}, not {baseline!r}")
    overall = ratio(F.col("all_hits"), F.col("all_n"))
    outside = ratio(F.col("all_hits") - F.col("hits"), F.col("all_n") - F.col("n"))
    return {"national": overall, "fallback": F.coalesce(outside, overall)}.get(baseline, outside)


def expected_rate(n: Column, base: Column) -> Column:
    """Aggregate: mean baseline over the rows of a group, cells without one left out."""
    covered = F.when(base.isNotNull(), n)
    return F.round(F.try_divide(F.sum(n * base), F.sum(covered).cast("double")), DIGITS)


def standardize_cells(cells: DataFrame, groups: list[str], baseline: str) -> DataFrame:
    """(groups, n, hits, rate, expected, gap) from cells that carry the totals of their stratum."""
    if baseline == "inner":
        cells = cells.where(F.col("all_n") > F.col("n"))
    out = cells.withColumn("base", baseline_rate(baseline)).groupBy(*groups).agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits"),
        ratio(F.sum("hits"), F.sum("n")).alias("rate"),
        expected_rate(F.col("n"), F.col("base")).alias("expected"),
    )
    return out.withColumn("gap", F.col("rate") - F.col("expected"))


def standardize(df: DataFrame, group: str, stratum: str, outcome: str, baseline: str = "outside") -> DataFrame:
    """Every group at once, in one pass over the rows."""
    cells = group_cells(df, [group], stratum, outcome)
    return standardize_cells(with_cell_totals(cells, stratum), [group], baseline)


def flag_cells(df: DataFrame, flags: list[str], stratum: str, outcome: str) -> DataFrame:
    """Counts per (signal, stratum) with and without the flag: n1, hits1, n0, hits0.

    Rows are first counted per combination of flags; only those counts are unpivoted, so the
    table is read once however many flags there are."""
    combos = df.groupBy(stratum, *flags).agg(
        F.count("*").alias("n"), F.sum(outcome).cast("long").alias("hits")
    )
    long = combos.unpivot([stratum, "n", "hits"], flags, "signal", "flag")
    on = F.col("flag") == 1
    zero = F.lit(0)
    return long.groupBy("signal", stratum).agg(
        F.sum(F.when(on, F.col("n")).otherwise(zero)).alias("n1"),
        F.sum(F.when(on, F.col("hits")).otherwise(zero)).alias("hits1"),
        F.sum(F.when(on, zero).otherwise(F.col("n"))).alias("n0"),
        F.sum(F.when(on, zero).otherwise(F.col("hits"))).alias("hits0"),
    )
