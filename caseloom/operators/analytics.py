"""Descriptive analyses of the case table. One pass over the cases each."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom import settings as S
from caseloom.functions.numbers import mean_of_rounded, percent, percent_of, rate, ratio, whole_div
from caseloom.operators.standardize import (
    baseline_rate, expected_rate, flag_cells, group_cells, standardize_cells, stratum_totals, with_cell_totals,
)


def over_all(aggregate: Column) -> Column:
    """Total over all rows; only ever used on aggregated rows."""
    return aggregate.over(Window.partitionBy())


def kpis(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("cases"),
        F.countDistinct("company").alias("companies"),
        percent_of("relief").alias("relief_rate_pct"),
        percent_of("monetary_relief").alias("monetary_relief_pct"),
        percent_of("timely").alias("timely_response_pct"),
        percent_of("is_duplicate_text").alias("duplicate_text_pct"),
        F.sum("in_region").alias("region_cases"),
        F.sum("in_metro").alias("metro_cases"),
        F.date_format(F.min("date_received"), "yyyy-MM-dd").alias("first_received"),
        F.date_format(F.max("date_received"), "yyyy-MM-dd").alias("last_received"),
    )


def product_rates(df: DataFrame) -> DataFrame:
    words = F.sum(F.col("narrative_words").cast("long"))
    return (
        df.groupBy("product").agg(
            F.count("*").alias("cases"),
            percent_of("relief").alias("relief_rate_pct"),
            percent_of("monetary_relief").alias("monetary_relief_pct"),
            percent_of("timely").alias("timely_pct"),
            whole_div(words * 2 + F.count("*"), F.count("*") * 2).alias("avg_words"),
        )
        .withColumn("share_pct", percent(F.col("cases"), over_all(F.sum("cases"))))
        .orderBy(F.desc("cases"), "product")
    )


def company_benchmark(df: DataFrame, other: str = S.OTHER_COMPANIES) -> DataFrame:
    """Largest companies against the rest. Main product: most cases, ties by name."""
    cells = df.groupBy("company_group", "product").agg(
        F.count("*").alias("n"), F.sum("relief").alias("relief"),
        F.sum("monetary_relief").alias("monetary"), F.sum("timely").alias("timely"),
    )
    cases = F.sum("n")
    return (
        cells.groupBy(F.col("company_group").alias("company")).agg(
            cases.alias("cases"),
            percent(F.sum("relief"), cases).alias("relief_rate_pct"),
            percent(F.sum("monetary"), cases).alias("monetary_relief_pct"),
            percent(F.sum("timely"), cases).alias("timely_pct"),
            F.min_by("product", F.struct(-F.col("n"), F.col("product"))).alias("main_product"),
        )
        .withColumn("share_pct", percent(F.col("cases"), over_all(F.sum("cases"))))
        .orderBy(F.col("company") == other, F.desc("cases"), "company")
    )


def main_category(df: DataFrame, group: str, category: str) -> DataFrame:
    """Categories of a group numbered by falling count (ties by name)."""
    place = Window.partitionBy(group).orderBy(F.desc("cases"), F.asc(category))
    return (
        df.groupBy(group, category).agg(F.count("*").alias("cases"))
        .withColumn("rn", F.row_number().over(place))
    )


def hotspots(df: DataFrame, min_cases: int = 1000) -> DataFrame:
    return (
        df.groupBy("product", "issue").agg(
            F.count("*").alias("cases"),
            percent_of("relief").alias("relief_rate_pct"),
            percent_of("monetary_relief").alias("monetary_relief_pct"),
        )
        .where(F.col("cases") >= min_cases)
        .orderBy(F.desc("relief_rate_pct"), "product", "issue")
    )


def signal_table(df: DataFrame, labels: dict[str, str] = S.SIGNAL_LABELS) -> DataFrame:
    """Outcome with and without each signal, and the gap to the rate expected from the product
    mix. Products in which every case has the signal leave all columns."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    cells = flag_cells(df, list(labels), "product", "relief").where(F.col("n0") > 0)
    base = ratio(F.col("hits0"), F.col("n0"))
    n1, hits1, n0, hits0 = (F.sum(c) for c in ("n1", "hits1", "n0", "hits0"))
    expected = F.try_divide(F.sum(F.col("n1") * base), n1.cast("double"))
    return (
        cells.groupBy("signal").agg(
            n1.alias("cases_with_signal"),
            percent(n1, n1 + n0).alias("share_pct"),
            percent(hits1, n1).alias("relief_with_pct"),
            percent(hits0, n0).alias("relief_without_pct"),
            F.round(expected * 100, 1).alias("expected_pct"),
            F.round((ratio(hits1, n1) - expected) * 100, 1).alias("mix_adjusted_gap_pts"),
        )
        .withColumn("signal", names[F.col("signal")])
        .orderBy(F.desc("mix_adjusted_gap_pts"), "signal")
    )


def segments(df: DataFrame, min_dup: int = 50) -> DataFrame:
    """Overlapping segments, all counted in one scan."""
    older, service = F.col("older_american") == 1, F.col("servicemember") == 1
    copied = F.col("is_duplicate_text") == 1
    # The names of the segments.
    tests = {
        "Older American": older,
        "Servicemember": service,
        "Untagged consumers": ~older & ~service,
        "Template text (filed 2+ times)": copied,
        "Unique text": ~copied,
        f"Template text filed {min_dup}+ times": F.col("dup_count") >= min_dup,
    }
    counted = df.agg(*[
        F.struct(
            F.lit(name).alias("segment"), F.count_if(test).alias("cases"),
            percent(F.sum(F.when(test, F.col("relief"))), F.count_if(test)).alias("relief_rate_pct"),
        ).alias(f"s{i}")
        for i, (name, test) in enumerate(tests.items())
    ])
    return counted.select(F.inline(F.array(*counted.columns)))


def region_mix(df: DataFrame) -> DataFrame:
    """Region against the rest, by product."""
    inside, relief = F.col("in_region"), F.col("relief")
    return (
        df.groupBy("product").agg(
            F.sum(inside).alias("region_cases"),
            F.sum("in_metro").alias("metro_cases"),
            F.sum(1 - inside).alias("rest"),
            percent_of(F.when(inside == 1, relief)).alias("region_relief_pct"),
            percent_of(F.when(inside == 0, relief)).alias("rest_relief_pct"),
        )
        .withColumns({
            "region_mix_pct": percent(F.col("region_cases"), over_all(F.sum("region_cases"))),
            "rest_mix_pct": percent(F.col("rest"), over_all(F.sum("rest"))),
        })
        .drop("rest").orderBy(F.desc("region_cases"), "product")
    )


def monthly_trend(df: DataFrame, product: str = S.TREND_PRODUCT) -> DataFrame:
    return (
        df.where(F.col("complete_month") == 1).groupBy("month").agg(
            F.count("*").alias("cases"),
            F.count_if(F.col("product") == product).alias("product_cases"),
            percent_of("relief").alias("relief_rate_pct"),
        ).orderBy("month")
    )


def theme_profile(df: DataFrame) -> DataFrame:
    """Size, outcomes, tone, region count, main product and expected rate of every theme."""
    cells = df.groupBy("theme", "product").agg(
        F.count("*").alias("n"), F.sum("relief").cast("long").alias("hits"),
        F.sum("monetary_relief").alias("monetary"), F.sum("in_region").alias("region"),
        F.sum(F.round(F.col("sentiment") * 10000).cast("long")).alias("tone"),
    )
    sized = with_cell_totals(cells, "product").withColumns({
        "base": baseline_rate("outside"), "theme_n": F.sum("n").over(Window.partitionBy("theme"))})
    n = F.sum("n")
    profile = sized.groupBy("theme").agg(
        n.alias("cases"),
        ratio(F.sum("hits"), n).alias("relief_rate"),
        ratio(F.sum("monetary"), n).alias("monetary_rate"),
        (ratio(F.sum("tone"), n) / 10000.0).alias("avg_sentiment"),
        F.sum("region").alias("region_cases"),
        F.min_by("product", F.struct(-F.col("n"), F.col("product"))).alias("top_product"),
        ratio(F.max("n"), n).alias("top_product_share"),
        F.count_if(F.col("n") * 20 >= F.col("theme_n")).alias("products_spanned"),
        expected_rate(F.col("n"), F.col("base")).alias("expected_rate"),
        F.sum("hits").alias("_hits"),
    )
    total = over_all(F.sum("cases"))
    return (
        profile.withColumn("share", ratio(F.col("cases"), total))
        .withColumn("relief_index", F.try_divide(
            F.col("relief_rate"), ratio(over_all(F.sum("_hits")), total)))
        .drop("_hits").orderBy(F.desc("cases"), "theme")
    )


def share_and_index(df: DataFrame, group: str, outcome: str = "relief") -> DataFrame:
    """Share of all cases and rate against the overall rate, per group."""
    total, hits = over_all(F.sum("cases")), over_all(F.sum("hits"))
    return (
        df.groupBy(group).agg(F.count("*").alias("cases"), F.sum(outcome).alias("hits"))
        .select(
            group, "cases", ratio(F.col("cases"), total).alias("share"),
            F.try_divide(ratio(F.col("hits"), F.col("cases")), ratio(hits, total)).alias("index"),
        )
    )


def row_share(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Cross-table whose rows sum to 1. The column values are given, so no pass looks for them."""
    return df.groupBy(row).agg(
        *[ratio(F.count_if(F.col(column) == v), F.count("*")).alias(v) for v in values]
    )


def companies_in_group(df: DataFrame, group: str = S.OTHER_COMPANIES) -> DataFrame:
    return df.where(F.col("company_group") == group).agg(
        F.countDistinct("company").alias("companies")
    )


CUBE_MEASURES = ("cases", "relief", "monetary_relief", "timely")


def case_cube(df: DataFrame, dims: list[str]) -> DataFrame:
    """Base cells of the filterable cube: outcome counts per combination of the dimensions."""
    return df.groupBy(*dims).agg(
        F.count("*").alias("cases"), F.sum("relief").alias("relief"),
        F.sum("monetary_relief").alias("monetary_relief"), F.sum("timely").alias("timely"),
    )


def roll_up(cells: DataFrame, dims: list[str]) -> DataFrame:
    """All sub-totals of base cells over `dims`; `level` tells which dimensions are summed out."""
    return cells.cube(*dims).agg(
        *[F.sum(m).alias(m) for m in CUBE_MEASURES], F.grouping_id().alias("level")
    )


def tone_table(df: DataFrame, buckets: str = "tone_quintile") -> DataFrame:
    """Size, mean tone, rate and expected rate of every tone bucket."""
    cells = df.groupBy(buckets, "product").agg(
        F.count("*").alias("n"), F.sum("relief").cast("long").alias("hits"),
        F.sum(F.round(F.col("sentiment") * 10000).cast("long")).alias("tone"),
    )
    based = with_cell_totals(cells, "product").withColumn("base", baseline_rate("outside"))
    n = F.sum("n")
    return based.groupBy(buckets).agg(
        n.alias("cases"), (ratio(F.sum("tone"), n) / 10000.0).alias("avg_sentiment"),
        ratio(F.sum("hits"), n).alias("relief_rate"),
        expected_rate(F.col("n"), F.col("base")).alias("expected_rate"),
    )


def measures(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates of any selection (`by` may be empty for the whole table)."""
    return df.groupBy(*by).agg(
        F.count("*").alias("cases"),
        F.sum("relief").alias("relief_count"),
        rate("relief").alias("relief_rate"),
        rate("monetary_relief").alias("monetary_rate"),
        rate("timely").alias("timely_rate"),
        rate("is_duplicate_text").alias("template_share"),
    )


def expected_measures(selection: DataFrame, cases: DataFrame, by: str) -> DataFrame:
    """Expected rate and gap in points of a selection, from the rates of all cases."""
    cells = group_cells(selection, [by], "product", "relief")
    totals = stratum_totals(cases, "product", "relief")
    joined = cells.join(totals, F.col("product").eqNullSafe(F.col("_stratum")))   # a null product is a stratum
    return standardize_cells(joined, [by], "national").select(
        by, F.col("n").alias("cases"), F.col("rate").alias("relief_rate"),
        F.col("expected").alias("expected_rate"), (F.col("gap") * 100).alias("gap_pts"),
    )


def model_measures(df: DataFrame, by: list[str], digits: int = 4) -> DataFrame:
    """Mean score, and routing accuracy over the rows that have a prediction."""
    return df.groupBy(*by).agg(
        mean_of_rounded("relief_score", digits).alias("avg_relief_score"),
        ratio(F.sum(F.col("route_correct").cast("long")), F.count("route_correct")).alias("routing_accuracy"),
    )


def capture(df: DataFrame, decile: str, by: list[str]) -> DataFrame:
    """Share of a selection's relief cases found in each score decile."""
    counted = df.groupBy(*by, decile).agg(F.sum("relief").alias("relief_count"))
    return counted.withColumn(
        "relief_capture", ratio(F.col("relief_count"), F.sum("relief_count").over(Window.partitionBy(*by)))
    )
