"""The whole analysis as five jobs that hand over written tables.

    python -m caseloom.plans.jobs RAW LEXICON OUT   (see `main`)
"""
from __future__ import annotations

import sys
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caseloom import settings as S
from caseloom.operators import (
    analytics as A, copies, excerpts, features, metrics as M, models, phrases, ranking, report as R, splits, star,
    tone, topics, vocabulary as V,
)
from caseloom.plans.lineage import cut
from caseloom.sources import cases as C, sinks


@dataclass
class Options:
    """Defaults are those of the published analysis."""
    out: str
    stop: list[str] | None = None            # None: Spark's English list and the domain list
    seeds: list = field(default_factory=lambda: S.TOPIC_SEEDS)
    topic_terms: int = 30_000
    topic_min_df: int = 25
    topic_max_df: float = 0.4
    topic_passes: int = 500
    first_sentences: int | None = None       # None: all sentences; the published tables use 40
    phrase_min_docs: int = 400
    hotspot_min_cases: int = 1000
    segment_min_dup: int = 50
    route_terms: int = 100_000
    outcome_terms: int = 50_000
    model_min_df: int = 5
    model_max_df: float = 0.5
    max_iter: int | None = None              # None: fits run to their optimum, which is checked
    folds: int = 5
    seed: int = 42
    target: float = 0.95
    source: str = ""                         # of the cases, as the report names it

    def table(self, name: str) -> str:
        return f"{self.out}/tables/{name}"


def bucket() -> Column:
    return ranking.id_bucket("case_id")


def clean_job(raw: DataFrame, o: Options) -> DataFrame:
    """Raw extract -> case table (Parquet). Fails on a product label without a short name."""
    df = C.map_labels(C.spread(raw, "complaint_id"), "product", "_short", S.PRODUCT_LABELS)
    df = C.fill_defaults(df).withColumnRenamed("_short", "product")
    for step in (features.outcome_flags, features.date_features, features.segment_flags, features.geo_flags,
                 features.text_features, features.signal_flags):
        df = step(df)
    df = cut(df.drop("date_sent_to_company"))   # texts are cleaned once, then counted and joined
    df = copies.mark_copies(df)
    df = ranking.fold_to_top(df, "company", 15, S.OTHER_COMPANIES, "company_group")
    sinks.write_table(df, f"{o.out}/cases")
    return raw.sparkSession.read.parquet(f"{o.out}/cases")


def register(out: str, spark: SparkSession) -> None:
    """Temporary views of what a finished run has written, for plain SQL: cases, text_features, model_scores, cube, and the
    star's fact_cases, dim_product, dim_theme, dim_company, dim_date."""
    for path in ("cases", "text_features", "model_scores", "cube", *[f"star/{t}" for t in ("fact_cases", "dim_product", "dim_theme", "dim_company", "dim_date")]):
        spark.read.parquet(f"{out}/{path}").createOrReplaceTempView(path.split("/")[-1])


def analysis_job(cases: DataFrame, o: Options) -> dict[str, DataFrame]:
    """The eight descriptive analyses. Narratives take no part: the view `cases` answers plain SQL too."""
    cases.createOrReplaceTempView("cases")
    results = {
        "kpis": A.kpis(cases),
        "product_rates": A.product_rates(cases),
        "company_benchmark": A.company_benchmark(cases),
        "issue_hotspots": A.hotspots(cases, o.hotspot_min_cases),
        "language_signals": A.signal_table(cases),
        "segments": A.segments(cases, o.segment_min_dup),
        "region_mix": A.region_mix(cases),
        "monthly_trend": A.monthly_trend(cases),
    }
    return save(results, o)


def save(results: dict[str, DataFrame], o: Options) -> dict[str, DataFrame]:
    """Write result tables as CSV for people and hand on written copies for later steps."""
    kept = {}
    for name, table in results.items():
        kept[name] = cut(table)
        sinks.write_result(kept[name], o.table(name))
    return kept


def text_job(cases: DataFrame, lexicon: DataFrame, o: Options) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Themes and tone of every case, and what they say about outcomes."""
    stop = V.default_stop_words() if o.stop is None else o.stop
    terms = V.term_table(cases, stop=stop, carry=("text_group", "narrative_words"))
    unique = cut(copies.first_per_group(terms).where("narrative_words >= 5"))
    vocab = cut(V.vocabulary(unique.select(F.inline("terms")), unique, o.topic_min_df, o.topic_max_df, o.topic_terms))
    model = topics.fit_topics(V.vectors(unique, vocab), vocab, o.seeds, o.topic_passes)
    for row in model.drift().where("drifted").collect():     # one row per topic
        print(f"Topic {row['topic_id']} ended away from its theme, {row['theme']}: its strongest terms hold "
              f"{row['kept']} of the {row['anchors']} it was started from")

    everything = V.vectors(terms, vocab)
    themes = model.assign(cases, everything)
    tones = tone.tone(cases, lexicon, first=o.first_sentences)
    sinks.write_table(themes.join(tones, "case_id"), f"{o.out}/text_features")
    text = cases.sparkSession.read.parquet(f"{o.out}/text_features")

    described = cases.drop("narrative", "narrative_clean").join(text, "case_id")
    described = described.withColumn("_tone", F.round(F.col("sentiment") * 10000).cast("int"))
    toned = cut(ranking.rank_bucket(described, "_tone", 5, "case_id", bucket(), "tone_quintile").drop("_tone"))
    candidates = cut(phrases.phrase_gaps(cases, o.phrase_min_docs, stop))
    products = sorted(set(S.PRODUCT_LABELS.values()))
    return text, save({
        "topic_terms": model.top_terms(15),
        "theme_summary": A.theme_profile(toned),
        "theme_product_mix": A.row_share(toned, "theme", "product", products),
        "sentiment_vs_relief": A.tone_table(toned).withColumn(
            "label", F.get(F.array(*[F.lit(x) for x in S.TONE_LABELS]), F.col("tone_quintile") - 1)),
        "phrase_gaps": phrases.phrase_table(candidates, 12),
    }, o)


def model_job(cases: DataFrame, o: Options) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Routing and outcome models, their evaluation, and a score for every case."""
    df = ranking.fold_to_top(cases, "company", 100, "Other", "company_model")
    df = features.scaled_log_words(df)
    df = cut(splits.group_holdout(df, "text_group", 0.2, o.seed))
    train, test = df.where("in_holdout = 0"), df.where("in_holdout = 1")
    fit = {"min_df": o.model_min_df, "max_df": o.model_max_df}

    terms = V.term_table(df, carry=("in_holdout",))     # texts are taken apart once for all models and folds
    parts = terms.where("in_holdout = 0"), terms.where("in_holdout = 1")
    router = models.fit_router(train, size=o.route_terms, max_iter=o.max_iter, terms=parts[0], **fit)
    routes = cut(router.predict(test, "product", terms=parts[1]).withColumn(
        "correct", (F.col("route_pred") == F.col("product")).cast("int")))
    scored = models.compare_variants(train, test, bucket(), max_iter=o.max_iter, terms=parts, size=o.outcome_terms, **fit)
    scored = {name: cut(table) for name, table in scored.items()}
    comparison = None
    for name, table in scored.items():
        row = M.model_row(table, name, "relief", "relief_score", "case_id", bucket())
        comparison = row if comparison is None else comparison.unionByName(row)
    results = save({
        "routing_report": M.class_report(routes, "product", "route_pred"),
        "routing_confusion": M.confusion(routes, "product", "route_pred", router.labels),
        "routing_confusion_pairs": M.confusion_shares(routes, "product", "route_pred"),
        "routing_automation": M.automation_curve(routes, "route_confidence", "correct"),
        "model_comparison": comparison,
        "relief_deciles": M.decile_table(scored["both"], "relief", "relief_score", "case_id", bucket()),
    }, o)

    oof = models.out_of_fold(df.drop("in_holdout"), o.folds, seed=o.seed, max_iter=o.max_iter, terms=terms,
                             size=o.outcome_terms, **fit)
    sinks.write_table(models.score_table(df, oof, routes, bucket()), f"{o.out}/model_scores")
    return cases.sparkSession.read.parquet(f"{o.out}/model_scores"), results


def export_job(cases: DataFrame, text: DataFrame, scores: DataFrame, results: dict[str, DataFrame], o: Options) -> None:
    """Star schema, packed columns, filterable cube and the report document."""
    full = cut(star.enrich(cases.drop("narrative", "narrative_clean"), text, scores, bucket()))     # texts stay where they are
    sinks.write_star(star.star_schema(full, results["topic_terms"]), f"{o.out}/star")
    sinks.write_table(star.packed(full), f"{o.out}/packed")
    sinks.write_table(star.dictionaries(full), f"{o.out}/packed_values")
    dims = ["product", "geo", "theme", "tone_quintile", "company_group", "month", "in_holdout",
            "relief_priority_decile", "is_duplicate_text", "older_american", "servicemember", *S.SIGNAL_PATTERNS]
    sinks.write_table(A.case_cube(features.geo_code(full), dims), f"{o.out}/cube")
    routing = R.routing_section(results["routing_report"], results["routing_automation"],
                                results["routing_confusion_pairs"], o.target)
    saved = save({
        "theme_gaps": R.theme_gaps(results["theme_summary"]),
        "language_gaps": R.language_gaps(results["language_signals"], results["sentiment_vs_relief"]),
        "gains": R.gains(results["relief_deciles"]),
        "excerpts": excerpts.pick_excerpts(full, texts=cases),
        "routing": routing,
        "other_companies": A.companies_in_group(full),
    }, o)
    document = sinks.report_json({
        "kpis": (results["kpis"], ["cases"]),
        "products": (results["product_rates"], ["product"]),
        "themes": (results["theme_summary"], ["theme"]),
        "topics": (results["topic_terms"], ["topic_id"]),
        "phrases": (results["phrase_gaps"], ["direction", "phrase"]),
        "deciles": (results["relief_deciles"], ["decile"]),
        "models": (results["model_comparison"], ["model"]),
        "routing": (saved["routing"], ["part", "item", "measure"]),
        "excerpts": (saved["excerpts"], ["theme", "case_id"]),
        "other_companies": (saved["other_companies"], ["companies"]),
    }, *R.description(full, results["topic_terms"].groupBy("theme").agg(F.min_by("top_terms", "topic_id").alias("top_terms")), source=o.source),
        *R.model_parts(saved["routing"], results["model_comparison"], results["relief_deciles"], results["phrase_gaps"]))
    sinks.write_json(document, f"{o.out}/report")
    facts = R.headlines_of(results["company_benchmark"], results["theme_summary"], results["language_signals"], results["sentiment_vs_relief"],
                           results["routing_automation"], results["model_comparison"], o.target)
    sinks.write_result(facts, f"{o.out}/headlines")


def run_all(raw: DataFrame, lexicon: DataFrame, o: Options) -> None:
    cases = clean_job(raw, o)
    results = analysis_job(cases, o)
    text, more = text_job(cases, lexicon, o)
    scores, evaluation = model_job(cases, o)
    export_job(cases, text, scores, {**results, **more, **evaluation}, o)


def main(raw: str, lexicon: str, out: str) -> None:
    """`raw`: headed CSV, plain (read in parallel splits) or gzip. `lexicon`: headed CSV with token, valence."""
    spark = SparkSession.builder.appName("caseloom").getOrCreate()
    words = spark.read.csv(lexicon, header=True, schema="token string, valence double")
    read = C.read_raw_csv if raw.endswith(".gz") else C.read_quoted_csv      # gzip has no splits
    run_all(read(spark, raw), words, Options(out))


if __name__ == "__main__":
    main(*sys.argv[1:4])
