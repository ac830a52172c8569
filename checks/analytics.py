"""Sources, row features, copies, descriptive analyses, standardization."""
from pyspark.sql import functions as F

from caseloom import settings as S
from caseloom.functions import text as X
from caseloom.functions.numbers import ratio
from caseloom.operators import analytics as A, copies, features, ranking, skew, standardize, star
from caseloom.plans.lineage import cut
from caseloom.sources.cases import unmapped_labels
from checks.adapters import (
    CASES, PRODUCTS, SIGNALS, TEXTS, case_bucket, cases_rel, cases_text, raw_lines, with_company_group,
    with_copies,
)
from checks.registry import pct, query, rat

day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)


# ---- sources ---------------------------------------------------------------------------
@query("s1_raw_cases", CASES + """
SELECT case_id, strftime(date_received, '%Y-%m-%d') AS date_received, product, sub_product, issue,
       sub_issue, company, state, zip3, tags, company_response, timely FROM cases""")
def raw_cases(spark, sf):
    return cases_rel(spark, sf).select(
        "case_id", day("date_received"), "product", "sub_product", "issue", "sub_issue", "company",
        "state", "zip3", "tags", "company_response", "timely")


@query("s2_label_map", CASES + """
SELECT product_full, product, count(*) AS cases FROM cases GROUP BY ALL""")
def label_map(spark, sf):
    return cases_rel(spark, sf, "p").groupBy("product_full", "product").agg(F.count("*").alias("cases"))


@query("s3_unmapped_labels", CASES + """
SELECT product_full AS product, count(*) AS cases FROM cases
WHERE product_full NOT IN ('SMALL', 'PROMO') GROUP BY ALL""")
def unmapped(spark, sf):
    known = {k: v for k, v in PRODUCTS.items() if k in ("SMALL", "PROMO")}
    return unmapped_labels(raw_lines(spark, sf, "p"), "product", known)


# ---- row features ------------------------------------------------------------------------
@query("p1_outcome_flags", CASES + """
SELECT company_response, relief, monetary_relief, count(*) AS cases FROM cases GROUP BY ALL""")
def outcome_flags(spark, sf):
    return cases_rel(spark, sf, "").groupBy("company_response", "relief", "monetary_relief").agg(
        F.count("*").alias("cases"))


@query("p2_date_features", CASES + """
SELECT case_id, month, days_to_company, complete_month FROM cases""")
def date_features(spark, sf):
    return cases_rel(spark, sf, "o").select("case_id", "month", "days_to_company", "complete_month")


@query("p3_segment_flags", CASES + """
SELECT case_id, tags, older_american, servicemember FROM cases""")
def segment_flags(spark, sf):
    return cases_rel(spark, sf, "c").select("case_id", "tags", "older_american", "servicemember")


@query("p4_geo_flags", CASES + """
SELECT case_id, state, zip3, in_region, in_metro FROM cases""")
def geo_flags(spark, sf):
    return cases_rel(spark, sf, "c").select("case_id", "state", "zip3", "in_region", "in_metro")


@query("p5_geo_label", CASES + """
SELECT CASE WHEN in_metro = 1 THEN 'Greater Houston' WHEN in_region = 1 THEN
       'Texas, outside Greater Houston' ELSE 'Rest of U.S.' END AS geo_label, count(*) AS cases
FROM cases GROUP BY ALL""")
def geo_label(spark, sf):
    return features.geo_label(cases_rel(spark, sf, "c")).groupBy("geo_label").agg(F.count("*").alias("cases"))


@query("p6_clean_text", TEXTS + "SELECT case_id, narrative_clean FROM cases")
def clean_text(spark, sf):
    return cases_text(spark, sf).select("case_id", "narrative_clean")


@query("p7_word_count", TEXTS + "SELECT case_id, CAST(narrative_words AS INT) AS narrative_words FROM cases")
def word_count(spark, sf):
    return cases_text(spark, sf).select("case_id", "narrative_words")


TEXT_SIGNALS = {
    "licensed": r"\blicense\b", "numbered": r"[0-9]{3}", "mailed": "@", "thisness": r"\bthis\b",
    "past": r"\bwas\b", "article": r"\b(?:the|die|que|pour)\b",
}


def _hit(word: str) -> str:
    edge = r"[^\p{L}\p{N}\p{M}_]"
    return f"CAST(regexp_matches(lower(narrative), '(?:^|{edge})(?:{word})(?:{edge}|$)') AS INT)"


TEXT_SIGNALS_SQL = f"""{_hit('license')} AS licensed,
       CAST(regexp_matches(lower(narrative), '[0-9]{{3}}') AS INT) AS numbered,
       CAST(contains(narrative, '@') AS INT) AS mailed, {_hit('this')} AS thisness,
       {_hit('was')} AS past, {_hit('the|die|que|pour')} AS article"""


@query("p8_signal_flags", TEXTS + f" SELECT case_id, {TEXT_SIGNALS_SQL} FROM cases")
def signal_flags(spark, sf):
    return features.signal_flags(cases_text(spark, sf), TEXT_SIGNALS).select("case_id", *TEXT_SIGNALS)


@query("p8_default_signals", TEXTS + r"""
SELECT case_id,
  CAST(regexp_matches(lower(narrative), '\b(?:attorney|lawyer|legal counsel|law firm)s?\b') AS INT) AS mentions_attorney,
  CAST(regexp_matches(lower(narrative), '\b(?:sue|suing|lawsuit|litigation|small claims|court)\b') AS INT) AS mentions_legal_action,
  CAST(regexp_matches(lower(narrative), '\b(?:cfpb|attorney general|ftc|federal trade commission|better business bureau|bbb)\b') AS INT) AS mentions_regulator,
  CAST(regexp_matches(lower(narrative), '(?:\bfcra\b|\bfdcpa\b|fair credit reporting act|fair debt collection|\b15 ?u\.?s\.?c|\b1681\w*|\b1692\w*)') AS INT) AS cites_law,
  CAST(regexp_matches(lower(narrative), '(?:identity theft|identity was stolen|stolen identity|not my account|fraudulent account)') AS INT) AS mentions_identity_theft,
  CAST(regexp_matches(lower(narrative), '\b(?:fee|fees|overdraft|interest charge)\b') AS INT) AS mentions_fees
FROM cases""")
def default_signals(spark, sf):
    return features.signal_flags(cases_text(spark, sf)).select("case_id", *S.SIGNAL_PATTERNS)


@query("p9_defaults", CASES + """
SELECT sub_product, sub_issue, company, state, tags, timely, count(*) AS cases FROM cases GROUP BY ALL""")
def defaults(spark, sf):
    return cases_rel(spark, sf).groupBy(
        "sub_product", "sub_issue", "company", "state", "tags", "timely").agg(F.count("*").alias("cases"))


@query("p11_log_words", CASES + """
SELECT case_id, round(ln(1 + narrative_words) / ln(1 + (SELECT max(narrative_words) FROM cases)), 9) AS log_words
FROM cases""")
def log_words(spark, sf):
    return features.scaled_log_words(cases_rel(spark, sf, "")).select(
        "case_id", F.round("log_words", 9).alias("log_words"))


@query("p12_display_text", TEXTS + r"""
SELECT case_id, regexp_replace(trim(regexp_replace(narrative, '\s+', ' ', 'g')),
       '\{\$([\d,\.]+)\}', '$\1', 'g') AS excerpt FROM cases""")
def display_text(spark, sf):
    return cases_text(spark, sf).select("case_id", X.display_text(F.col("narrative")).alias("excerpt"))


# ---- copies and top categories ---------------------------------------------------------------
@query("d1_text_group", TEXTS + "SELECT case_id, text_group FROM cases")
def text_group(spark, sf):
    return cases_text(spark, sf).select("case_id", "text_group")


@query("d2_copies", TEXTS + "SELECT case_id, dup_count, is_duplicate_text FROM cases")
def text_copies(spark, sf):
    return with_copies(cases_text(spark, sf).select("case_id", "text_group")).select(
        "case_id", "dup_count", "is_duplicate_text")


@query("d2_line_groups", CASES + "SELECT case_id, dup_count, is_duplicate_text FROM cases")
def line_groups(spark, sf):
    return with_copies(cases_rel(spark, sf, "").select("case_id", "text_group")).select(
        "case_id", "dup_count", "is_duplicate_text")


@query("d3_first_per_group", TEXTS + """
SELECT case_id, narrative FROM cases QUALIFY row_number() OVER (PARTITION BY text_group ORDER BY case_id) = 1""")
def first_per_group(spark, sf):
    return copies.first_per_group(cases_text(spark, sf)).select("case_id", "narrative")


@query("d4_company_group", CASES + "SELECT company, company_group, count(*) AS cases FROM cases GROUP BY ALL")
def company_group(spark, sf):
    return with_company_group(cases_rel(spark, sf, "p")).groupBy("company", "company_group").agg(
        F.count("*").alias("cases"))


@query("d5_company_model", CASES + """,
top40 AS (SELECT company FROM cases GROUP BY company ORDER BY count(*) DESC, company LIMIT 40)
SELECT CASE WHEN company IN (SELECT company FROM top40) THEN company ELSE 'Other' END AS company_model,
       count(*) AS cases FROM cases GROUP BY ALL""")
def company_model(spark, sf):
    return ranking.fold_to_top(cases_rel(spark, sf, "p"), "company", 40, "Other", "company_model").groupBy(
        "company_model").agg(F.count("*").alias("cases"))


# ---- descriptive analyses ------------------------------------------------------------------------
@query("a1_kpis", CASES + f"""
SELECT count(*) AS cases, count(DISTINCT company) AS companies,
       {pct('sum(relief)', 'count(*)')} AS relief_rate_pct,
       {pct('sum(monetary_relief)', 'count(*)')} AS monetary_relief_pct,
       {pct('sum(timely)', 'count(*)')} AS timely_response_pct,
       {pct('sum(is_duplicate_text)', 'count(*)')} AS duplicate_text_pct,
       CAST(sum(in_region) AS BIGINT) AS region_cases, CAST(sum(in_metro) AS BIGINT) AS metro_cases,
       strftime(min(date_received), '%Y-%m-%d') AS first_received,
       strftime(max(date_received), '%Y-%m-%d') AS last_received
FROM cases""")
def kpis(spark, sf):
    df = cut(cases_rel(spark, sf).select(
        "company", "relief", "monetary_relief", "timely", "in_region", "in_metro", "date_received", "text_group", "h"))
    return A.kpis(copies.mark_copies(df, row_id="h"))


@query("a2_product_rates", CASES + f"""
SELECT product, count(*) AS cases, {pct('count(*)', 'CAST(sum(count(*)) OVER () AS BIGINT)')} AS share_pct,
       {pct('sum(relief)', 'count(*)')} AS relief_rate_pct,
       {pct('sum(monetary_relief)', 'count(*)')} AS monetary_relief_pct,
       {pct('sum(timely)', 'count(*)')} AS timely_pct,
       CAST((2 * sum(narrative_words) + count(*)) // (2 * count(*)) AS BIGINT) AS avg_words
FROM cases GROUP BY product""")
def product_rates(spark, sf):
    return A.product_rates(cases_rel(spark, sf, "p"))


@query("a3_company_benchmark", CASES + f""",
cells AS (SELECT company_group, product, count(*) AS n, CAST(sum(relief) AS BIGINT) AS paid,
                 CAST(sum(monetary_relief) AS BIGINT) AS money, CAST(sum(timely) AS BIGINT) AS prompt
          FROM cases GROUP BY ALL)
SELECT company_group AS company, CAST(sum(n) AS BIGINT) AS cases,
       {pct('sum(n)', 'CAST(sum(sum(n)) OVER () AS BIGINT)')} AS share_pct,
       {pct('sum(paid)', 'CAST(sum(n) AS BIGINT)')} AS relief_rate_pct,
       {pct('sum(money)', 'CAST(sum(n) AS BIGINT)')} AS monetary_relief_pct,
       {pct('sum(prompt)', 'CAST(sum(n) AS BIGINT)')} AS timely_pct,
       first(product ORDER BY n DESC, product) AS main_product
FROM cells GROUP BY company_group""")
def company_benchmark(spark, sf):
    return A.company_benchmark(with_company_group(cases_rel(spark, sf, "p")))


@query("a4_hotspots", CASES + f"""
SELECT product, issue, count(*) AS cases, {pct('sum(relief)', 'count(*)')} AS relief_rate_pct,
       {pct('sum(monetary_relief)', 'count(*)')} AS monetary_relief_pct
FROM cases GROUP BY product, issue HAVING count(*) >= 2000""")
def hotspots(spark, sf):
    return A.hotspots(cases_rel(spark, sf, "op"), 2000)


# By signal and product: cases and outcomes with it (n1, r1) and without (n0, r0). A product in which every case
# has the signal tells nothing about its absence.
SIGNAL_CELLS = " UNION ALL ".join(
    f"""SELECT '{label}' AS signal, product, sum({flag}) AS n1, sum(1 - {flag}) AS n0, sum(relief * {flag}) AS r1,
       sum(relief * (1 - {flag})) AS r0 FROM cases GROUP BY product HAVING min({flag}) = 0"""
    for flag, label in SIGNALS.items())


@query("a5_signal_table", CASES + f""",
t AS (SELECT signal, CAST(sum(n1) AS BIGINT) AS n1, CAST(sum(n0) AS BIGINT) AS n0, CAST(sum(r1) AS BIGINT) AS r1,
             CAST(sum(r0) AS BIGINT) AS r0, sum(n1 * CAST(r0 AS DOUBLE) / n0) AS mixed
      FROM ({SIGNAL_CELLS}) GROUP BY signal)
SELECT signal, n1 AS cases_with_signal, {pct('n1', '(n1 + n0)')} AS share_pct,
       {pct('r1', 'n1')} AS relief_with_pct, {pct('r0', 'n0')} AS relief_without_pct,
       round(100 * mixed / n1, 1) AS expected_pct, round(100 * (r1 - mixed) / n1, 1) + 0e0 AS mix_adjusted_gap_pts
FROM t""")
def signal_table(spark, sf):
    return A.signal_table(cases_rel(spark, sf, "p"), SIGNALS)


_segments = " UNION ALL ".join(
    f"SELECT '{name}' AS segment, count(*) AS cases, {pct('sum(relief)', 'count(*)')} AS relief_rate_pct"
    f" FROM cases WHERE {test}"
    for name, test in {
        "Older American": "older_american = 1", "Servicemember": "servicemember = 1",
        "Untagged consumers": "older_american = 0 AND servicemember = 0",
        "Template text (filed 2+ times)": "is_duplicate_text = 1", "Unique text": "is_duplicate_text = 0",
        "Template text filed 8+ times": "dup_count >= 8"}.items())


@query("a6_segments", CASES + _segments)
def segments(spark, sf):
    return A.segments(with_copies(cases_rel(spark, sf, "oc")), 8)


@query("a7_region_mix", CASES + f"""
SELECT product, CAST(sum(in_region) AS BIGINT) AS region_cases, CAST(sum(in_metro) AS BIGINT) AS metro_cases,
       {pct('sum(in_region)', 'CAST(sum(sum(in_region)) OVER () AS BIGINT)')} AS region_mix_pct,
       {pct('sum(1 - in_region)', 'CAST(sum(sum(1 - in_region)) OVER () AS BIGINT)')} AS rest_mix_pct,
       {pct('sum(CASE WHEN in_region = 1 THEN relief END)', 'CAST(sum(in_region) AS BIGINT)')} AS region_relief_pct,
       {pct('sum(CASE WHEN in_region = 0 THEN relief END)', 'CAST(sum(1 - in_region) AS BIGINT)')} AS rest_relief_pct
FROM cases GROUP BY product""")
def region_mix(spark, sf):
    return A.region_mix(cases_rel(spark, sf, "pc"))


@query("a8_monthly_trend", CASES + f"""
SELECT month, count(*) AS cases, count(*) FILTER (WHERE product = 'Promo goods') AS product_cases,
       {pct('sum(relief)', 'count(*)')} AS relief_rate_pct
FROM cases WHERE complete_month = 1 GROUP BY month""")
def monthly_trend(spark, sf):
    return A.monthly_trend(cases_rel(spark, sf, "op"), "Promo goods")


PROFILE = """
profile AS (
  SELECT theme, count(*) AS cases, sum(relief) AS r, sum(monetary_relief) AS m, sum(tone_units) AS t,
         sum(in_region) AS g FROM cases GROUP BY theme),
cells AS (SELECT theme, product, count(*) AS n, sum(relief) AS r FROM cases GROUP BY ALL),
strata AS (SELECT product, sum(n) AS alln, sum(r) AS allr FROM cells GROUP BY ALL),
expectation AS (
  SELECT theme, round(sum(n * (CAST(allr - cells.r AS DOUBLE) / nullif(alln - n, 0)))
         / sum(CASE WHEN alln > n THEN n END), 9) AS expected_rate
  FROM cells JOIN strata USING (product) GROUP BY theme),
tops AS (
  SELECT theme, product AS top_product, n AS top_n FROM cells
  QUALIFY row_number() OVER (PARTITION BY theme ORDER BY n DESC, product) = 1),
spans AS (
  SELECT c.theme, count(*) FILTER (WHERE CAST(n AS DOUBLE) / cases >= 0.05) AS products_spanned
  FROM cells c JOIN profile p ON p.theme = c.theme GROUP BY ALL),
theme_summary AS (
  SELECT p.theme, cases, CAST(r AS DOUBLE) / cases AS relief_rate, CAST(m AS DOUBLE) / cases AS monetary_rate,
         CAST(t AS DOUBLE) / cases / 10000 AS avg_sentiment, CAST(g AS BIGINT) AS region_cases, top_product,
         CAST(top_n AS DOUBLE) / cases AS top_product_share, products_spanned, expected_rate,
         CAST(cases AS DOUBLE) / (SELECT count(*) FROM cases) AS share,
         (CAST(r AS DOUBLE) / cases) / (SELECT CAST(sum(relief) AS DOUBLE) / count(*) FROM cases) AS relief_index
  FROM profile p JOIN expectation USING (theme) JOIN tops USING (theme) JOIN spans USING (theme))"""


@query("a9_theme_profile", CASES + "," + PROFILE + " SELECT * FROM theme_summary")
def theme_profile(spark, sf):
    return A.theme_profile(cases_rel(spark, sf))


@query("a10_share_and_index", CASES + f"""
SELECT issue, count(*) AS cases, {rat('count(*)', '(SELECT count(*) FROM cases)')} AS share,
       (CAST(sum(relief) AS DOUBLE) / count(*)) / (SELECT CAST(sum(relief) AS DOUBLE) / count(*) FROM cases) AS index
FROM cases GROUP BY issue""")
def share_and_index(spark, sf):
    return A.share_and_index(cases_rel(spark, sf, "o"), "issue")


_columns = ", ".join(
    f"CAST(count(*) FILTER (WHERE product = '{p}') AS DOUBLE) / count(*) AS \"{p}\"" for p in sorted(PRODUCTS.values()))


@query("a11_theme_product_mix", CASES + f"SELECT theme, {_columns} FROM cases GROUP BY theme")
def theme_product_mix(spark, sf):
    return A.row_share(cases_rel(spark, sf, "p"), "theme", "product", sorted(PRODUCTS.values()))


@query("a12_ordered_categories", CASES + """
SELECT company_group, count(*) AS n, CAST(row_number() OVER (
       ORDER BY company_group = 'All other companies', count(*) DESC, company_group) - 1 AS INT) AS place
FROM cases GROUP BY company_group""")
def ordered_categories(spark, sf):
    return ranking.ordered_categories(
        with_company_group(cases_rel(spark, sf, "p")), "company_group", S.OTHER_COMPANIES)


@query("a13_other_companies", CASES + """
SELECT count(DISTINCT company) AS companies FROM cases WHERE company_group = 'All other companies'""")
def other_companies(spark, sf):
    return A.companies_in_group(with_company_group(cases_rel(spark, sf, "p")))


QUINTILES = """,
toned AS (
  SELECT *, CAST(greatest(1, ((row_number() OVER (ORDER BY tone_units, case_id) - 1) * 5 + count(*) OVER () - 2)
         // (count(*) OVER () - 1)) AS INT) AS tone_quintile FROM cases)"""
CUBE_DIMS = ["product", "geo", "theme", "tone_quintile", "company_group", "month", "older_american",
             "servicemember", "is_duplicate_text"]


def tone_bucketed(df):
    return ranking.rank_bucket(df, "tone_units", 5, "case_id", case_bucket(), "tone_quintile")


@query("a14_case_cube", CASES + QUINTILES + """
SELECT product, CASE WHEN in_metro = 1 THEN 2 WHEN in_region = 1 THEN 1 ELSE 0 END AS geo, theme, tone_quintile,
       company_group, month, older_american, servicemember, is_duplicate_text, count(*) AS cases,
       CAST(sum(relief) AS BIGINT) AS relief, CAST(sum(monetary_relief) AS BIGINT) AS monetary_relief,
       CAST(sum(timely) AS BIGINT) AS timely
FROM toned GROUP BY ALL""")
def case_cube(spark, sf):
    """The columns of the cube are written once: copies, groups and tone cuts are found on them, not on the joins again. The
    tone is ranked before the rows move to their copies, which its keys needn't."""
    df = cut(features.geo_code(cases_rel(spark, sf)).select(
        "case_id", "product", "geo", "theme", "tone_units", "company", "month", "older_american", "servicemember",
        "relief", "monetary_relief", "timely", "text_group", "h"))
    df = with_company_group(tone_bucketed(df)).drop("case_id", "tone_units", "company")
    return A.case_cube(copies.mark_copies(df, row_id="h"), CUBE_DIMS)


@query("a14_cube_totals", CASES + """
SELECT product, CASE WHEN in_metro = 1 THEN 2 WHEN in_region = 1 THEN 1 ELSE 0 END AS geo, count(*) AS cases,
       CAST(sum(relief) AS BIGINT) AS relief, CAST(sum(monetary_relief) AS BIGINT) AS monetary_relief,
       CAST(sum(timely) AS BIGINT) AS timely, CAST(grouping(product, geo) AS BIGINT) AS level
FROM cases GROUP BY CUBE (product, geo)""")
def cube_totals(spark, sf):
    cells = A.case_cube(features.geo_code(cases_rel(spark, sf, "pc")), ["product", "geo"])
    return A.roll_up(cells, ["product", "geo"])


# ---- standardization ------------------------------------------------------------------------------------
_CELLS = """,
cells AS (SELECT company_group, product, count(*) AS n, sum(relief) AS hits FROM cases GROUP BY ALL),
strata AS (SELECT product, sum(n) AS alln, sum(hits) AS allhits FROM cells GROUP BY ALL),
rates AS (SELECT *, (CAST(allhits AS DOUBLE) - hits) / nullif(alln - n, 0) AS outside,
                 CAST(allhits AS DOUBLE) / alln AS overall FROM cells JOIN strata USING (product))
"""


def _standardized(base: str, where: str = "true") -> str:
    return CASES + _CELLS + f"""
SELECT company_group, CAST(sum(n) AS BIGINT) AS n, CAST(sum(hits) AS BIGINT) AS hits,
       CAST(sum(hits) AS DOUBLE) / sum(n) AS rate,
       round(sum(n * ({base})) / sum(CASE WHEN ({base}) IS NOT NULL THEN n END), 9) AS expected,
       CAST(sum(hits) AS DOUBLE) / sum(n)
       - round(sum(n * ({base})) / sum(CASE WHEN ({base}) IS NOT NULL THEN n END), 9) AS gap
FROM rates WHERE {where} GROUP BY company_group"""


def _register(name: str, baseline: str, sql: str):
    @query(name, sql)
    def run(spark, sf):
        df = with_company_group(cases_rel(spark, sf, "p"))
        return standardize.standardize(df, "company_group", "product", "relief", baseline)


_register("x1_standardize_inner", "inner", _standardized("outside", "alln > n"))
_register("x2_standardize_outside", "outside", _standardized("outside"))
_register("x3_standardize_fallback", "fallback", _standardized("coalesce(outside, overall)"))
_register("x4_standardize_national", "national", _standardized("overall"))


# ---- ranks and windows ------------------------------------------------------------------------------------
@query("w1_main_category", CASES + """
SELECT company, product, count(*) AS cases,
       CAST(row_number() OVER (PARTITION BY company ORDER BY count(*) DESC, product) AS INT) AS rn
FROM cases GROUP BY company, product""")
def main_category(spark, sf):
    return A.main_category(cases_rel(spark, sf, "p"), "company", "product")


@query("w3_tone_quintile", CASES + QUINTILES + " SELECT case_id, tone_quintile FROM toned")
def tone_quintile(spark, sf):
    return tone_bucketed(cases_rel(spark, sf, "").select("case_id", "tone_units")).select(
        "case_id", "tone_quintile")


@query("w3_global_rank", CASES + """
SELECT case_id, row_number() OVER (ORDER BY tone_units DESC, case_id) AS rank, count(*) OVER () AS ranked FROM cases""")
def global_rank(spark, sf):
    return ranking.global_rank(
        cases_rel(spark, sf, "").select("case_id", "tone_units"), "tone_units", "case_id", case_bucket(), True
    ).select("case_id", "rank", "ranked")


TONE = """,
tone_cells AS (SELECT tone_quintile, product, count(*) AS n, sum(relief) AS r, sum(tone_units) AS t FROM toned GROUP BY ALL),
tone_strata AS (SELECT product, sum(n) AS alln, sum(r) AS allr FROM tone_cells GROUP BY ALL),
tone_table AS (
  SELECT tone_quintile, CAST(sum(n) AS BIGINT) AS cases, CAST(sum(t) AS DOUBLE) / sum(n) / 10000 AS avg_sentiment,
         CAST(sum(r) AS DOUBLE) / sum(n) AS relief_rate,
         round(sum(n * (CAST(allr - r AS DOUBLE) / (alln - n))) / sum(n), 9) AS expected_rate
  FROM tone_cells JOIN tone_strata USING (product) GROUP BY tone_quintile)"""


@query("w5_tone_table", CASES + QUINTILES + TONE + " SELECT * FROM tone_table")
def tone_table(spark, sf):
    return A.tone_table(tone_bucketed(cases_rel(spark, sf, "p")))


# ---- joins and sets -------------------------------------------------------------------------------------------
@query("j6_signal_union", CASES + "," + """
signals AS (SELECT 'bulk' AS signal, product, relief FROM cases WHERE bulk = 1
            UNION ALL SELECT 'taxed', product, relief FROM cases WHERE taxed = 1)
SELECT signal, product, count(*) AS cases, CAST(sum(relief) AS BIGINT) AS relief FROM signals GROUP BY ALL""")
def signal_union(spark, sf):
    df = cases_rel(spark, sf, "p")
    parts = [df.where(F.col(s) == 1).select(F.lit(s).alias("signal"), "product", "relief") for s in ("bulk", "taxed")]
    return parts[0].unionByName(parts[1]).groupBy("signal", "product").agg(
        F.count("*").alias("cases"), F.sum("relief").alias("relief"))


@query("j7_distinct_pairs", CASES + "SELECT DISTINCT product, product_full FROM cases")
def distinct_pairs(spark, sf):
    return cases_rel(spark, sf, "p").select("product", "product_full").distinct()


@query("w2_share_of_total", CASES + f"""
SELECT issue, count(*) AS cases, {rat('count(*)', 'sum(count(*)) OVER ()')} AS share FROM cases GROUP BY issue""")
def share_of_total(spark, sf):
    return A.share_and_index(cases_rel(spark, sf, "o"), "issue").drop("index")


@query("j1_join_of_aggregates", CASES + """,
sizes AS (SELECT company, count(*) AS n FROM cases GROUP BY company),
places AS (SELECT company, product, row_number() OVER (PARTITION BY company ORDER BY count(*) DESC, product) AS rn
           FROM cases GROUP BY company, product)
SELECT sizes.company, n, product FROM sizes JOIN places ON places.company = sizes.company AND rn = 1""")
def join_of_aggregates(spark, sf):
    df = cases_rel(spark, sf, "p")
    sizes = df.groupBy("company").agg(F.count("*").alias("n"))
    return sizes.join(A.main_category(df, "company", "product").where("rn = 1"), "company").select("company", "n", "product")


@query("j2_left_enrichment", TEXTS + "SELECT case_id, company_response, relief FROM cases")
def left_enrichment(spark, sf):
    return cases_text(spark, sf).select("case_id", "company_response", "relief")


@query("j3_surrogate_keys", CASES + """,
dp AS (SELECT product, CAST(row_number() OVER (ORDER BY product) AS INT) AS product_id FROM (SELECT DISTINCT product FROM cases)),
dc AS (SELECT company, CAST(row_number() OVER (ORDER BY company) AS INT) AS company_id FROM (SELECT DISTINCT company FROM cases))
SELECT case_id, product_id, company_id FROM cases JOIN dp USING (product) JOIN dc USING (company)""")
def surrogate_keys(spark, sf):
    df = cut(cases_rel(spark, sf, "p").select("case_id", "product", "company"))
    keyed = df
    for key in ("product", "company"):
        table = cut(star.dimension(df, f"{key}_id", key))
        keyed = skew.look_up(keyed, table, key, "cases", "case_id").drop("cases")
    return keyed.select("case_id", "product_id", "company_id")


@query("j4_scalar_subquery", CASES + f"""
SELECT company, {rat('count(*)', '(SELECT count(*) FROM cases)')} AS share FROM cases GROUP BY company""")
def scalar_subquery(spark, sf):
    df = cases_rel(spark, sf, "p")
    total = df.agg(F.count("*")).scalar()
    return df.groupBy("company").agg(F.count("*").alias("n")).select("company", ratio(F.col("n"), total).alias("share"))


@query("j5_membership", CASES + """
SELECT company IN (SELECT company FROM top15) AS top, count(*) AS cases, CAST(sum(relief) AS BIGINT) AS relief
FROM cases GROUP BY ALL""")
def membership(spark, sf):
    df = cases_rel(spark, sf, "p")
    top = F.broadcast(ranking.top_categories(df, "company", 15).select("company"))   # 15 rows
    parts = [df.join(top, "company", how).withColumn("top", F.lit(how == "left_semi")) for how in ("left_semi", "left_anti")]
    return parts[0].unionByName(parts[1]).groupBy("top").agg(F.count("*").alias("cases"), F.sum("relief").alias("relief"))
