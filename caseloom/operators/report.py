"""Report tables built from result tables; all inputs are small."""
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from caseloom import settings as S
from caseloom.operators import ranking
from caseloom.operators.analytics import companies_in_group
from caseloom.operators.metrics import first_threshold, top_confusions
from caseloom.sources import sinks


def theme_gaps(themes: DataFrame) -> DataFrame:
    """Actual against expected rate per theme, unclassified left out."""
    return (
        themes.where(F.col("theme") != S.UNCLASSIFIED)
        .select("theme", "cases", "relief_rate", "expected_rate",
                (F.col("relief_rate") - F.col("expected_rate")).alias("gap"))
        .orderBy("gap", "theme")
    )


def language_gaps(signals: DataFrame, tones: DataFrame, bucket: str = "tone_quintile", last: int = 5,
                  labels=S.TONE_EDGE_LABELS) -> DataFrame:
    """Gaps of all signals and of the first and last tone bucket in one table."""
    gap = F.round((F.col("relief_rate") - F.col("expected_rate")) * 100, 1)
    edges = tones.where(F.col(bucket).isin(1, last)).select(
        F.when(F.col(bucket) == 1, labels[0]).otherwise(labels[1]).alias("signal"),
        gap.alias("mix_adjusted_gap_pts"), F.col("cases").alias("cases_with_signal"),
    )
    return (
        signals.select("signal", "mix_adjusted_gap_pts", "cases_with_signal").unionByName(edges)
        .orderBy("mix_adjusted_gap_pts", "signal")
    )


def gains(deciles: DataFrame) -> DataFrame:
    """Cumulative gains curve from the origin."""
    points = deciles.select((F.col("decile") / F.lit(10.0)).alias("reviewed"),
                            F.col("cumulative_capture").alias("captured"))
    origin = deciles.sparkSession.createDataFrame([(0.0, 0.0)], "reviewed double, captured double")
    return origin.unionByName(points)


def _facts(table: DataFrame, test, values: dict) -> DataFrame:
    """(fact, value) rows read from the rows of `table` that pass the test."""
    pairs = [F.struct(F.lit(name).alias("fact"), value.cast("double").alias("value")) for name, value in values.items()]
    return table.where(test).select(F.inline(F.array(*pairs)))


def headlines(companies: DataFrame, themes: DataFrame, signals: DataFrame, tones: DataFrame, curve: DataFrame,
              models: DataFrame, best_company: str, worst_company: str, best_theme: str, other_theme: str,
              signal: str, model: str, target: float = 0.95) -> DataFrame:
    """(fact, value): the numbers the headline findings quote, looked up by key."""
    c, gap = F.col, (F.col("relief_rate") - F.col("expected_rate")) * 100
    parts = [
        _facts(companies, c("company") == best_company, {"best company relief pct": c("relief_rate_pct")}),
        _facts(companies, c("company") == worst_company, {"worst company relief pct": c("relief_rate_pct")}),
        _facts(themes, c("theme") == best_theme, {"best theme relief rate": c("relief_rate"), "best theme gap pts": gap}),
        _facts(themes, c("theme") == other_theme, {"other theme relief rate": c("relief_rate")}),
        _facts(signals, c("signal") == signal, {"signal gap pts": c("mix_adjusted_gap_pts")}),
        _facts(tones, c("tone_quintile") == 1, {"most negative relief rate": c("relief_rate")}),
        _facts(tones, c("tone_quintile") == 5, {"least negative relief rate": c("relief_rate")}),
        _facts(first_threshold(curve, target), F.lit(True), {
            "routed automatically": c("coverage"), "accuracy when routed": c("accuracy")}),
        _facts(models, c("model") == model, {"capture in top fifth": c("capture_top20")}),
    ]
    return reduce(DataFrame.unionByName, parts)


def routing_section(report: DataFrame, curve: DataFrame, shares: DataFrame, target: float = 0.95, k: int = 4) -> DataFrame:
    """(part, item, measure, value): everything a report says about routing.

    Parts: summary, class, curve (thresholds with an accuracy), target, confusion."""
    c = F.col
    summary = ("accuracy", "macro avg", "weighted avg")

    def rows(table: DataFrame, part: str, item, values: dict) -> DataFrame:
        pairs = [F.struct(F.lit(part).alias("part"), item.cast("string").alias("item"),
                          F.lit(name).alias("measure"), value.cast("double").alias("value"))
                 for name, value in values.items()]
        return table.select(F.inline(F.array(*pairs)))

    step = F.format_number("threshold", 2)
    return reduce(DataFrame.unionByName, [
        rows(report.where(c("label") == "accuracy"), "summary", F.lit("all"), {"accuracy": c("precision")}),
        rows(report.where(c("label") == "macro avg"), "summary", F.lit("all"), {"macro_f1": c("f1"), "n_test": c("support")}),
        rows(report.where(~c("label").isin(*summary)), "class", c("label"), {
            "precision": c("precision"), "recall": c("recall"), "f1": c("f1"), "support": c("support")}),
        rows(curve.where(c("accuracy").isNotNull()), "curve", step, {"coverage": c("coverage"), "accuracy": c("accuracy")}),
        rows(first_threshold(curve, target), "target", step, {"coverage": c("coverage"), "accuracy": c("accuracy")}),
        rows(top_confusions(shares, k), "confusion", F.concat("actual", F.lit(" > "), "predicted"), {"share": c("share")}),
    ])


def description(df: DataFrame, theme_terms: DataFrame, month: str = "month", window=S.COMPLETE_MONTHS, source: str = "",
                geo=S.GEO_LABELS, signals=tuple(S.SIGNAL_LABELS.values()), tones=S.TONE_LABELS, terms: int = 6) -> list[DataFrame]:
    """Parts of the report document (section, json) on what the cases are: `meta` (cases, dates, window, source), `dims` (the
    values of every dimension in the order of the packed columns, and labels) and `theme_terms` (first terms of
    each theme; `theme_terms` has theme, top_terms)."""
    shown = lambda c: F.date_format(c, "yyyy-MM-dd")
    constant = df.sparkSession.range(1)
    known = ranking.ordered_categories(df, "theme", S.UNCLASSIFIED)
    first = F.array_join(F.slice(F.split(F.coalesce("top_terms", F.lit("")), ", "), 1, terms), ", ")
    listed = lambda values: F.first(F.array(*[F.lit(v) for v in values]))
    return [
        sinks.json_value("meta.n", df, F.count("*")),
        sinks.json_value("meta.date_min", df, shown(F.min("date_received"))),
        sinks.json_value("meta.date_max", df, shown(F.max("date_received"))),
        sinks.json_value("meta.complete_months", constant, listed(window)),
        sinks.json_value("meta.source", constant, F.first(F.lit(source))),
        sinks.json_list("dims.product", ranking.ordered_categories(df, "product"), "product", "place"),
        sinks.json_list("dims.theme", known, "theme", "place"),
        sinks.json_list("dims.company", ranking.ordered_categories(df, "company_group", S.OTHER_COMPANIES), "company_group", "place"),
        sinks.json_list("dims.month", df.select(month).distinct(), month, month),
        sinks.json_value("dims.other_company_count", companies_in_group(df), F.max("companies")),
        *[sinks.json_value(f"dims.{name}", constant, listed(values)) for name, values in (("geo", geo), ("signal", signals), ("tone", tones))],
        sinks.json_map("theme_terms", known.join(theme_terms.select("theme", "top_terms"), "theme", "left").withColumn("first", first), "theme", "first"),
    ]


def model_parts(section: DataFrame, comparison: DataFrame, deciles: DataFrame, phrases: DataFrame) -> list[DataFrame]:
    """Parts of the report document on the models: `models.routing` from the routing section, `models.relief` from the model
    comparison, the deciles and the phrases of both directions."""
    c = F.col
    of = lambda part: section.where(c("part") == part)
    wide = lambda part, key, measures: of(part).groupBy(c("item").alias(key)).agg(
        *[F.max(F.when(c("measure") == m, c("value"))).alias(m) for m in measures])
    single = [sinks.json_value(f"models.routing.{m}", of("summary").where(c("measure") == m), F.max("value")) for m in ("accuracy", "macro_f1", "n_test")]
    pairs = of("confusion").select(F.split("item", " > ").alias("p"), "value").select(
        F.element_at("p", 1).alias("actual"), F.element_at("p", 2).alias("predicted"), c("value").alias("share"))
    sides = [sinks.json_section(f"models.relief.phrases_{name}", phrases.where(c("direction").startswith(start)).select("phrase", "cases", "relief_rate", "gap_pts"), ["phrase"])
             for name, start in (("up", "more"), ("down", "less"))]
    return [
        *single,
        sinks.json_section("models.routing.per_class", wide("class", "product", ("precision", "recall", "f1", "support")), ["product"]),
        sinks.json_section("models.routing.automation", wide("curve", "threshold", ("coverage", "accuracy")), ["threshold"]),
        sinks.json_section("models.routing.at_target", wide("target", "threshold", ("coverage", "accuracy")), ["threshold"]),
        sinks.json_section("models.routing.confusions", pairs, ["actual", "predicted"]),
        sinks.json_section("models.relief.comparison", comparison, ["model"]),
        sinks.json_section("models.relief.deciles", deciles, ["decile"]),
        *sides,
    ]


def headlines_of(companies: DataFrame, themes: DataFrame, signals: DataFrame, tones: DataFrame, curve: DataFrame, models: DataFrame,
                 target: float = 0.95) -> DataFrame:
    """Headlines on the extremes: the companies and themes with the most and the least relief, the signal with the largest
    gap, the model with the best capture. Ties go by name. The tables have a row per group."""
    def top(table: DataFrame, name: str, by, most: bool = True):
        found = table.where(F.col(name).isNotNull()).orderBy(by.desc_nulls_last() if most else by.asc_nulls_last(), name).select(name).first()
        return found[0] if found else ""

    gap, pct = F.col("relief_rate") - F.col("expected_rate"), F.col("relief_rate_pct")
    named = companies.where(F.col("company") != S.OTHER_COMPANIES)
    known = themes.where(F.col("theme") != S.UNCLASSIFIED)
    return headlines(
        companies, themes, signals, tones, curve, models, top(named, "company", pct), top(named, "company", pct, False),
        top(known, "theme", gap), top(known, "theme", gap, False), top(signals, "signal", F.col("mix_adjusted_gap_pts")),
        top(models, "model", F.col("capture_top20")), target)
