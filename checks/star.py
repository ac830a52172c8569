"""Star schema, packed columns, measures, report tables, sinks."""
from pyspark.sql import functions as F, types as T

from caseloom.operators import analytics as A, features, metrics as M, ranking, report as R, splits, star
from caseloom.plans.lineage import cut, new_folder
from caseloom.sources import cases as C, sinks
from checks import analytics as QA, evaluation as QE
from checks.adapters import (
    CASES, PRODUCTS, SCORED, SIGNALS, case_bucket, cases_rel, raw_lines, scored, with_company_group,
    with_copies,
)
from checks.registry import pct, query, rat

# ---- everything known about a case ------------------------------------------------------------
ENRICHED = SCORED + """,
order_of_groups AS (
  SELECT text_group, row_number() OVER (ORDER BY md5(concat('42|', text_group))) AS place, count(*) OVER () AS g
  FROM (SELECT DISTINCT text_group FROM scored)),
placed AS (
  SELECT s.*, CAST(o.place <= CAST(ceil(g / 5.0) AS BIGINT) AS INT) AS in_holdout,
         row_number() OVER (ORDER BY tone_units, case_id) AS tr, row_number() OVER (ORDER BY score_u DESC, case_id) AS sr,
         count(*) OVER () AS nn
  FROM scored s JOIN order_of_groups o ON s.text_group = o.text_group),
enriched AS (
  SELECT *, CAST(greatest(1, ((tr - 1) * 5 + nn - 2) // (nn - 1)) - 1 AS INT) AS tone_quintile,
         CAST(greatest(1, ((sr - 1) * 10 + nn - 2) // (nn - 1)) AS INT) AS relief_priority_decile,
         CASE WHEN in_holdout = 1 THEN pred END AS route_pred,
         CASE WHEN in_holdout = 1 THEN CAST(pred = product AS DOUBLE) END AS route_correct
  FROM placed)"""


def side_tables(df, *carry):
    """(text features, model scores and carried columns) keyed by case_id, from written scored cases."""
    text = df.select("case_id", "theme", "sentiment")
    split = splits.group_holdout(df, "text_group", 0.2, 42)
    bucketed = ranking.rank_bucket(
        split.select("case_id", *carry, "in_holdout", "relief_score", "pred", "route_confidence"),
        "relief_score", 10, "case_id", case_bucket(), "relief_priority_decile", True)
    held = F.col("in_holdout") == 1
    return text, bucketed.select(
        "case_id", *carry, "in_holdout", "relief_score", F.when(held, F.col("pred")).alias("route_pred"),
        F.when(held, F.col("route_confidence")).alias("route_confidence"), "relief_priority_decile")


UNUSED = ("date_sent_to_company", "tags", "tone_units", "h", "score_u", "conf_u", "correct", "complete_month")
SCORE_COLUMNS = ("theme", "sentiment", "tone_units", "h", "score_u", "conf_u", "correct", "relief_score",
                 "route_confidence", "pred")


# Rows that lie together are alike, so the written table and the exchange of its rows take fewer bytes.
ALIKE = ("product_full", "company", "issue", "state", "zip3", "company_response", "date_received")


def parts(spark, sf):
    """(clean cases, written once, and the same with their copies marked and joined with their side tables).

    Copies are marked in the side table of the scores: a whole case moves once, to meet its side tables. Ids, which the adapter
    makes by md5, move as their 16 bytes, in the same order as their digits."""
    cases = scored(spark, sf, "opc").drop(*UNUSED).withColumn("case_id", F.unhex("case_id"))
    base = with_company_group(cut(cases.sortWithinPartitions(*ALIKE)))
    text, scores = side_tables(base, "text_group")
    full = star.enrich(base.drop(*SCORE_COLUMNS), text, with_copies(scores).drop("text_group"), case_bucket())
    return base, full.withColumn("case_id", F.lower(F.hex("case_id")))


def enriched(spark, sf):
    return parts(spark, sf)[1]


def with_scores(spark, sf, *columns):
    base = cut(scored(spark, sf))
    return base.select("case_id", *columns).join(side_tables(base)[1], "case_id", "left")


@query("s5_side_tables", ENRICHED + """
SELECT case_id, theme, sentiment, in_holdout, relief_score, route_pred, relief_priority_decile, tone_quintile FROM enriched""")
def side_table_join(spark, sf):
    return enriched(spark, sf).select(
        "case_id", "theme", "sentiment", "in_holdout", "relief_score", "route_pred", "relief_priority_decile",
        "tone_quintile")


@query("p13_route_correct", ENRICHED + "SELECT case_id, route_pred, route_correct FROM enriched")
def route_correct(spark, sf):
    df = with_scores(spark, sf, "product")
    return features.route_correct(df).select("case_id", "route_pred", "route_correct")


# ---- dimensions and fact ----------------------------------------------------------------------------
@query("b1_dim_product", CASES + """
SELECT CAST(row_number() OVER (ORDER BY product) AS INT) AS product_id, product, product_full
FROM (SELECT DISTINCT product, product_full FROM cases)""")
def dim_product(spark, sf):
    return star.dimension(cases_rel(spark, sf, "p"), "product_id", "product", ["product_full"]).drop("cases")


@query("b1_dim_company", CASES + """
SELECT CAST(row_number() OVER (ORDER BY company) AS INT) AS company_id, company, company_group
FROM (SELECT DISTINCT company, company_group FROM cases)""")
def dim_company(spark, sf):
    df = with_company_group(cases_rel(spark, sf, "p"))
    return star.dimension(df, "company_id", "company", ["company_group"]).drop("cases")


def brand_terms(spark, sf):
    """Stand-in topic table: one topic per (brand, type), the type as its terms."""
    pairs = spark.read.parquet(f"{sf}/part.parquet").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("topic_id"))
    return pairs.selectExpr("topic_id", "p_brand AS theme", "p_type AS top_terms")


@query("b2_dim_theme", CASES + """,
firsts AS (SELECT p_brand AS theme, arg_min(p_type, p_partkey) AS top_terms FROM part GROUP BY p_brand)
SELECT CAST(row_number() OVER (ORDER BY theme) AS INT) AS theme_id, theme, coalesce(top_terms, '') AS top_terms
FROM (SELECT DISTINCT theme FROM cases) LEFT JOIN firsts USING (theme)""")
def dim_theme(spark, sf):
    return star.theme_dimension(cases_rel(spark, sf, "p"), brand_terms(spark, sf)).drop("cases")


@query("b3_dim_date", CASES + """
SELECT strftime(d, '%Y-%m-%d') AS date, CAST(year(d) AS INT) AS year, 'Q' || quarter(d) AS quarter,
       CAST(month(d) AS INT) AS month_number, strftime(d, '%b %Y') AS month,
       strftime(date_trunc('month', d), '%Y-%m-%d') AS month_start, dayname(d) AS weekday
FROM (SELECT CAST(unnest(generate_series(min(date_received), max(date_received), INTERVAL 1 DAY)) AS DATE) AS d FROM cases)""")
def dim_date(spark, sf):
    as_text = {c: F.date_format(c, "yyyy-MM-dd") for c in ("date", "month_start")}
    return star.date_dimension(cases_rel(spark, sf, "o")).withColumns(as_text)


_signals = tuple(SIGNALS)


@query("b4_fact", ENRICHED + f""",
dp AS (SELECT product, CAST(row_number() OVER (ORDER BY product) AS INT) AS product_id FROM (SELECT DISTINCT product FROM cases)),
dt AS (SELECT theme, CAST(row_number() OVER (ORDER BY theme) AS INT) AS theme_id FROM (SELECT DISTINCT theme FROM cases)),
dc AS (SELECT company, CAST(row_number() OVER (ORDER BY company) AS INT) AS company_id FROM (SELECT DISTINCT company FROM cases))
SELECT case_id, strftime(date_received, '%Y-%m-%d') AS date_received, product_id, theme_id, company_id, state, zip3,
       in_region, in_metro, issue, sub_issue, company_response, relief, monetary_relief, timely, days_to_company,
       older_american, servicemember, {', '.join(_signals)}, sentiment, tone_quintile, is_duplicate_text,
       narrative_words, relief_score, relief_priority_decile, in_holdout, route_pred,
       CASE WHEN in_holdout = 1 THEN route_confidence END AS route_confidence, route_correct
FROM enriched JOIN dp USING (product) JOIN dt USING (theme) JOIN dc USING (company)""")
def fact(spark, sf):
    base, full = parts(spark, sf)
    tables = star.star_schema(full, brand_terms(spark, sf), _signals, base)
    return tables["fact_cases"].withColumn("date_received", F.date_format("date_received", "yyyy-MM-dd"))


def _bits(parts):
    return " | ".join(f"({c} << {b})" for c, b in parts)


@query("p10_packed", ENRICHED + f""",
pp AS (SELECT product, row_number() OVER (ORDER BY count(*) DESC, product) - 1 AS p FROM enriched GROUP BY product),
tt AS (SELECT theme, row_number() OVER (ORDER BY count(*) DESC, theme) - 1 AS t FROM enriched GROUP BY theme),
cc AS (SELECT company_group, row_number() OVER (ORDER BY company_group = 'All other companies', count(*) DESC, company_group) - 1 AS c
       FROM enriched GROUP BY company_group),
mm AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS m FROM enriched GROUP BY month)
SELECT case_id,
  CAST({_bits([('p', 0), ('(CASE WHEN in_metro = 1 THEN 2 WHEN in_region = 1 THEN 1 ELSE 0 END)', 4), ('relief', 6), ('monetary_relief', 7)])} AS INT) AS b0,
  CAST({_bits([('t', 0), ('tone_quintile', 5)])} AS INT) AS b1, CAST({_bits([('c', 0), ('m', 4)])} AS INT) AS b2,
  CAST({_bits([*[(s, i) for i, s in enumerate(_signals)], ('timely', 6), ('in_holdout', 7)])} AS INT) AS b3,
  CAST({_bits([('(relief_priority_decile - 1)', 0), ('is_duplicate_text', 4), ('older_american', 5), ('servicemember', 6)])} AS INT) AS b4
FROM enriched JOIN pp USING (product) JOIN tt USING (theme) JOIN cc USING (company_group) JOIN mm USING (month)""")
def packed(spark, sf):
    base, full = parts(spark, sf)
    return star.packed(full, _signals, source=base)


# ---- measures -------------------------------------------------------------------------------------------
@query("b5_measures", CASES + f"""
SELECT theme, month, count(*) AS cases, CAST(sum(relief) AS BIGINT) AS relief_count,
       {rat('sum(relief)', 'count(*)')} AS relief_rate, {rat('sum(monetary_relief)', 'count(*)')} AS monetary_rate,
       {rat('sum(timely)', 'count(*)')} AS timely_rate, {rat('sum(is_duplicate_text)', 'count(*)')} AS template_share
FROM cases GROUP BY theme, month""")
def measures(spark, sf):
    return A.measures(with_copies(cases_rel(spark, sf, "op")), ["theme", "month"])


@query("b6_expected_rate", CASES + """,
national AS (SELECT product, CAST(sum(relief) AS DOUBLE) / count(*) AS p FROM cases GROUP BY product),
chosen AS (SELECT company, product, count(*) AS n, sum(relief) AS r FROM cases WHERE in_region = 1 GROUP BY ALL),
sums AS (SELECT company, CAST(sum(n) AS BIGINT) AS cases, CAST(sum(r) AS DOUBLE) / sum(n) AS relief_rate,
                round(sum(n * p) / sum(n), 9) AS expected_rate FROM chosen JOIN national USING (product) GROUP BY company)
SELECT *, (relief_rate - expected_rate) * 100 AS gap_pts FROM sums""")
def expected_rate(spark, sf):
    df = cases_rel(spark, sf, "pc")
    return A.expected_measures(df.where("in_region = 1"), df, "company")


@query("b7_model_measures", ENRICHED + f"""
SELECT product, {rat('sum(score_u)', 'count(*)')} / 1e6 AS avg_relief_score,
       {rat('sum(route_correct)', 'count(route_correct)')} AS routing_accuracy
FROM enriched GROUP BY product""")
def model_measures(spark, sf):
    df = with_scores(spark, sf, "product")
    return A.model_measures(features.route_correct(df), ["product"], digits=6)


@query("b8_capture", ENRICHED + f"""
SELECT product, relief_priority_decile, CAST(sum(relief) AS BIGINT) AS relief_count,
       {rat('sum(relief)', 'sum(sum(relief)) OVER (PARTITION BY product)')} AS relief_capture
FROM enriched GROUP BY product, relief_priority_decile""")
def capture(spark, sf):
    df = with_scores(spark, sf, "product", "relief")
    return A.capture(df, "relief_priority_decile", ["product"])


# ---- report tables ------------------------------------------------------------------------------------------
@query("r1_theme_gaps", CASES + "," + QA.PROFILE + """
SELECT theme, cases, relief_rate, expected_rate, relief_rate - expected_rate AS gap FROM theme_summary""")
def theme_gaps(spark, sf):
    return R.theme_gaps(QA.theme_profile(spark, sf))


LANGUAGE = QA.QUINTILES + QA.TONE + f""",
signal_gaps AS (
  SELECT signal, round(100 * (sum(r1) - sum(n1 * CAST(r0 AS DOUBLE) / n0)) / sum(n1), 1) + 0e0 AS mix_adjusted_gap_pts,
         CAST(sum(n1) AS BIGINT) AS cases_with_signal
  FROM ({QA.SIGNAL_CELLS}) GROUP BY signal)"""


@query("r2_language_gaps", CASES + LANGUAGE + """
SELECT * FROM signal_gaps UNION ALL
SELECT CASE tone_quintile WHEN 1 THEN 'Most negative tone (bottom 20%)' ELSE 'Least negative tone (top 20%)' END,
       round(100 * (relief_rate - expected_rate), 1) + 0e0, cases FROM tone_table WHERE tone_quintile IN (1, 5)""")
def language_gaps(spark, sf):
    return R.language_gaps(QA.signal_table(spark, sf), QA.tone_table(spark, sf))


@query("r3_gains", SCORED + QE.DECILED + QE.DECILES + """
SELECT 0e0 AS reviewed, 0e0 AS captured UNION ALL SELECT decile / 10e0, cumulative_capture FROM deciles""")
def gains(spark, sf):
    return R.gains(QE.decile_table(spark, sf))


@query("r4_headlines", SCORED + LANGUAGE + "," + QA.PROFILE + QE.CURVE + "," + QE.LIFT + f"""
SELECT 'best company relief pct' AS fact, {pct('sum(relief)', 'count(*)')} AS value FROM cases WHERE company = 'red plate'
UNION ALL SELECT 'worst company relief pct', {pct('sum(relief)', 'count(*)')} FROM cases WHERE company = 'hot ring'
UNION ALL SELECT 'best theme relief rate', relief_rate FROM theme_summary WHERE theme = 'Brand#3'
UNION ALL SELECT 'best theme gap pts', (relief_rate - expected_rate) * 100 FROM theme_summary WHERE theme = 'Brand#3'
UNION ALL SELECT 'other theme relief rate', relief_rate FROM theme_summary WHERE theme = 'Brand#9'
UNION ALL SELECT 'signal gap pts', mix_adjusted_gap_pts FROM signal_gaps WHERE signal = 'High tax'
UNION ALL SELECT 'most negative relief rate', relief_rate FROM tone_table WHERE tone_quintile = 1
UNION ALL SELECT 'least negative relief rate', relief_rate FROM tone_table WHERE tone_quintile = 5
UNION ALL (SELECT 'routed automatically', coverage FROM curve WHERE accuracy >= 0.9 ORDER BY threshold LIMIT 1)
UNION ALL (SELECT 'accuracy when routed', accuracy FROM curve WHERE accuracy >= 0.9 ORDER BY threshold LIMIT 1)
UNION ALL SELECT 'capture in top fifth', capture_top20 FROM lifted""")
def headlines(spark, sf):
    # the cases with their parts are joined and written once, and what the facts need of each table is made once
    df = cut(scored(spark, sf).select("case_id", "product", "company", "relief", "monetary_relief", "timely", *SIGNALS,
                                      "tone_units", "sentiment", "route_confidence", "correct"))
    rates = ("relief_rate", "expected_rate")
    return R.headlines(
        cut(A.company_benchmark(with_company_group(df, 100)).select("company", "relief_rate_pct")),
        cut(QA.theme_profile(spark, sf).select("theme", *rates)),
        cut(A.signal_table(df, SIGNALS).select("signal", "mix_adjusted_gap_pts")),
        cut(A.tone_table(QA.tone_bucketed(df)).select("tone_quintile", *rates)),
        cut(M.automation_curve(df, "route_confidence", "correct")),
        cut(QE.model_row(spark, sf).select("model", "capture_top20")),
        "red plate", "hot ring", "Brand#3", "Brand#9", "High tax", "stand-in", 0.9)


@query("r5_routing_section", SCORED + QE.REPORT + QE.CURVE + QE.SHARES + """,
target AS (SELECT * FROM curve WHERE accuracy >= 0.9 ORDER BY threshold LIMIT 1)
SELECT 'summary' AS part, 'all' AS item, 'accuracy' AS measure, precision AS value FROM report WHERE label = 'accuracy'
UNION ALL SELECT 'summary', 'all', 'macro_f1', f1 FROM report WHERE label = 'macro avg'
UNION ALL SELECT 'summary', 'all', 'n_test', support FROM report WHERE label = 'macro avg'
UNION ALL SELECT 'class', label, unnest(['precision', 'recall', 'f1', 'support']), unnest([precision, recall, f1, support]) FROM prf
UNION ALL SELECT 'curve', printf('%.2f', threshold), unnest(['coverage', 'accuracy']), unnest([coverage, accuracy])
          FROM curve WHERE accuracy IS NOT NULL
UNION ALL SELECT 'target', printf('%.2f', threshold), unnest(['coverage', 'accuracy']), unnest([coverage, accuracy]) FROM target
UNION ALL SELECT 'confusion', actual || ' > ' || predicted, 'share', share FROM worst""")
def routing_section(spark, sf):
    shares = M.confusion_shares(scored(spark, sf), "product", "pred")
    return R.routing_section(QE.class_report(spark, sf), QE.automation_curve(spark, sf), shares, 0.9)


# ---- sinks: written, read back, compared -----------------------------------------------------------------------
@query("s1_csv_source", CASES + """
SELECT case_id, strftime(date_received, '%Y-%m-%d') AS date_received, product, sub_product, company, state, zip3, tags, timely
FROM cases""")
def csv_source(spark, sf):
    path = new_folder(spark)
    sinks.write_csv_gz(raw_lines(spark, sf), path)
    schema = T.StructType([
        T.StructField(f.name, T.StringType() if f.name == "complaint_id" else f.dataType) for f in C.RAW_SCHEMA])
    df = C.fill_defaults(C.map_labels(C.read_raw_csv(spark, path, schema), "product", "short", PRODUCTS))
    return df.select("case_id", F.date_format("date_received", "yyyy-MM-dd").alias("date_received"),
                     F.col("short").alias("product"), "sub_product", "company", "state", "zip3", "tags", "timely")


@query("s1_quoted_csv", """
SELECT doc_id AS case_id, md5(text) AS text, length(text) AS chars, source AS company, CAST(n_chars AS VARCHAR) AS n_chars FROM documents""")
def quoted_csv(spark, sf):
    """Whole texts, line breaks and quotes included, through plain CSV files that are read in parallel splits."""
    path = new_folder(spark)
    docs = C.spread(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    docs.write.option("escape", '"').option("quoteAll", True).csv(path, header=True)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("text", "source", "n_chars")]])
    df = C.read_quoted_csv(spark, path, schema)
    return df.select(F.col("doc_id").alias("case_id"), F.md5("text").alias("text"), F.length("text").cast("long").alias("chars"),
                     F.col("source").alias("company"), "n_chars")


@query("s4_table_round_trip", CASES + """
SELECT case_id, month, product, relief, dup_count FROM cases""")
def table_round_trip(spark, sf):
    path = new_folder(spark)
    sinks.write_table(with_copies(cases_rel(spark, sf, "op")).select(
        "case_id", "month", "product", "relief", "dup_count"), path, "month")
    return spark.read.schema("case_id string, month string, product string, relief int, dup_count bigint").parquet(path)


@query("s6_result_csv", CASES + f"""
SELECT company, count(*) AS cases, {rat('sum(relief)', 'count(*)')} AS relief_rate FROM cases GROUP BY company""")
def result_csv(spark, sf):
    path = new_folder(spark)
    result = A.measures(with_copies(cases_rel(spark, sf, "p")), ["company"]).select("company", "cases", "relief_rate")
    sinks.write_result(result, path)
    return spark.read.schema("company string, cases bigint, relief_rate double").csv(path, header=True)


@query("s7_star_tables", ENRICHED + """
SELECT product, company, theme, count(*) AS cases, CAST(sum(relief) AS BIGINT) AS relief FROM enriched GROUP BY ALL""")
def star_tables(spark, sf):
    """Write the five tables, read them back, answer a question over the star."""
    path = new_folder(spark)
    base, full = parts(spark, sf)
    sinks.write_star(star.star_schema(full, brand_terms(spark, sf), _signals, base), path)
    t = lambda name: spark.read.parquet(f"{path}/{name}")
    joined = t("fact_cases").join(t("dim_product"), "product_id").join(t("dim_theme"), "theme_id").join(
        t("dim_company"), "company_id")
    return joined.groupBy("product", "company", "theme").agg(F.count("*").alias("cases"), F.sum("relief").alias("relief"))


@query("s8_report_json")
def report_json(spark, sf):
    return sinks.report_json({
        "products": (QA.product_rates(spark, sf), ["product"]),
        "deciles": (QE.decile_table(spark, sf), ["decile"]),
        "automation": (QE.automation_curve(spark, sf), ["threshold"]),
        "routing": (QE.class_report(spark, sf), ["label"]),
    })


DOCUMENT = """products array<struct<product:string,cases:bigint>>, meta struct<n:bigint,date_min:string,date_max:string,complete_months:array<string>>,
 dims struct<product:array<string>,theme:array<string>,company:array<string>,month:array<string>,other_company_count:bigint,geo:array<string>>,
 theme_terms map<string,string>, models struct<routing:struct<accuracy:double,macro_f1:double,n_test:double,
 per_class:array<struct<product:string,support:double>>>, relief:struct<deciles:array<struct<decile:int,cases:bigint>>>>"""


def _listed(name: str, table: str, value: str, order: str) -> str:
    return f"SELECT 'dims.{name}', CAST(row_number() OVER (ORDER BY {order}) - 1 AS VARCHAR), {value} FROM {table} GROUP BY {value}"


@query("s8_parsed_document", SCORED + QE.REPORT + QE.DECILED + QE.DECILES + f""",
firsts AS (SELECT p_brand AS theme, arg_min(p_type, p_partkey) AS top_terms FROM part GROUP BY p_brand)
SELECT 'products' AS section, product AS item, CAST(count(*) AS VARCHAR) AS value FROM cases GROUP BY product
UNION ALL SELECT 'meta', 'n', CAST(count(*) AS VARCHAR) FROM cases
UNION ALL SELECT 'meta', 'date_min', strftime(min(date_received), '%Y-%m-%d') FROM cases
UNION ALL SELECT 'meta', 'date_max', strftime(max(date_received), '%Y-%m-%d') FROM cases
UNION ALL SELECT 'meta', 'complete_months', '2019-01 2019-10'
UNION ALL {_listed('product', 'cases', 'product', 'count(*) DESC, product')}
UNION ALL {_listed('theme', 'cases', 'theme', 'count(*) DESC, theme')}
UNION ALL {_listed('company', 'cases', 'company_group', "company_group = 'All other companies', count(*) DESC, company_group")}
UNION ALL {_listed('month', 'cases', 'month', 'month')}
UNION ALL SELECT 'dims', 'other_company_count', CAST(count(DISTINCT company) AS VARCHAR) FROM cases WHERE company_group = 'All other companies'
UNION ALL SELECT 'theme_terms', theme, top_terms FROM firsts WHERE theme IN (SELECT theme FROM cases)
UNION ALL SELECT 'models.routing', 'accuracy', CAST(CAST(round(1e6 * precision) AS BIGINT) AS VARCHAR) FROM report WHERE label = 'accuracy'
UNION ALL SELECT 'models.routing', 'macro_f1', CAST(CAST(round(1e6 * f1) AS BIGINT) AS VARCHAR) FROM report WHERE label = 'macro avg'
UNION ALL SELECT 'models.routing.per_class', label, CAST(CAST(support AS BIGINT) AS VARCHAR) FROM prf
UNION ALL SELECT 'models.relief.deciles', CAST(decile AS VARCHAR), CAST(cases AS VARCHAR) FROM deciles""")
def parsed_document(spark, sf):
    """The report document, parsed again."""
    df = cut(with_company_group(cases_rel(spark, sf, "op")))
    firsts = brand_terms(spark, sf).groupBy("theme").agg(F.min_by("top_terms", "topic_id").alias("top_terms"))
    none = spark.createDataFrame([], "direction string, phrase string, cases long, relief_rate double, gap_pts double")
    document = sinks.report_json(
        {"products": (QA.product_rates(spark, sf), ["product"])}, *R.description(df, firsts),
        *R.model_parts(routing_section(spark, sf), QE.model_row(spark, sf), QE.decile_table(spark, sf), none))
    d = document.select(F.from_json("value", DOCUMENT).alias("d"))
    at, text = (lambda *c: F.struct(*[x.cast("string").alias(n) for n, x in zip(("section", "item", "value"), c)])), F.lit
    each = lambda name, array, item, value: F.transform(array, lambda x: at(text(name), item(x), value(x)))
    names = lambda name: F.transform(F.col(f"d.dims.{name}"), lambda x, i: at(text(f"dims.{name}"), i, x))
    millionths = lambda c: F.round(F.col(c) * 1e6).cast("long")
    rows = F.concat(
        each("products", F.col("d.products"), lambda x: x["product"], lambda x: x["cases"]),
        F.array(at(text("meta"), text("n"), F.col("d.meta.n")), at(text("meta"), text("date_min"), F.col("d.meta.date_min")),
                at(text("meta"), text("date_max"), F.col("d.meta.date_max")),
                at(text("meta"), text("complete_months"), F.array_join("d.meta.complete_months", " ")),
                at(text("dims"), text("other_company_count"), F.col("d.dims.other_company_count")),
                at(text("models.routing"), text("accuracy"), millionths("d.models.routing.accuracy")),
                at(text("models.routing"), text("macro_f1"), millionths("d.models.routing.macro_f1"))),
        *[names(n) for n in ("product", "theme", "company", "month")],
        each("theme_terms", F.map_entries("d.theme_terms"), lambda x: x["key"], lambda x: x["value"]),
        each("models.routing.per_class", F.col("d.models.routing.per_class"), lambda x: x["product"], lambda x: x["support"].cast("long")),
        each("models.relief.deciles", F.col("d.models.relief.deciles"), lambda x: x["decile"], lambda x: x["cases"]))
    return d.select(F.inline(rows))
