"""The driver's tables in the shape of the raw extract, and the same in SQL."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom import settings as S
from caseloom.operators import copies, features
from caseloom.operators.ranking import fold_to_top, prefix_bucket
from caseloom.plans.lineage import cut
from caseloom.sources.cases import fill_defaults, map_labels, spread

PRODUCTS = {
    "SMALL": "Small goods", "ECONOMY": "Economy goods", "MEDIUM": "Medium goods",
    "PROMO": "Promo goods", "LARGE": "Large goods", "STANDARD": "Standard goods",
}
LANGUAGES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish"}
WINDOW = ("1995-02", "2001-06")
STATE, METRO = "AMERICA", ("771", "776")
SIGNALS = {
    "bulk": "Bulk quantity", "taxed": "High tax", "listed": "Little discount",
    "opened": "Line still open", "first_line": "First line", "pricey": "High price",
}

# Column of the raw extract -> (expression, tables it needs besides lineitem:
# o orders, p part, c customer with nation and region).
RAW_FIELDS = {
    "complaint_id": ("md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
                     " date_format(l_shipdate, 'yyyy-MM-dd')))", ""),
    "date_received": ("CAST(o_orderdate AS DATE)", "o"),
    "date_sent_to_company": ("CAST(l_shipdate AS DATE)", ""),
    "product": ("p_type", "p"),
    "sub_product": ("nullif(p_brand, 'Brand#11')", "p"),
    "issue": ("o_orderpriority", "o"),
    "sub_issue": ("nullif(l_linestatus, 'O')", ""),
    "company": ("concat(' ', p_name, ' ')", "p"),
    "state": ("nullif(r_name, 'ASIA')", "c"),
    "zip_code": ("concat(CAST(770 + n_nationkey AS STRING), 'XX')", "c"),
    "tags": ("CASE c_mktsegment WHEN 'BUILDING' THEN 'Older American' WHEN 'MACHINERY' THEN"
             " 'Servicemember' WHEN 'AUTOMOBILE' THEN 'Older American, Servicemember' END", "c"),
    "company_response_to_consumer": (
        "CASE WHEN l_returnflag <> 'R' THEN 'Closed with explanation' WHEN l_linestatus = 'F' THEN"
        " 'Closed with monetary relief' ELSE 'Closed with non-monetary relief' END", ""),
    "timely_response": ("CASE WHEN l_discount < 0.09 THEN 'Yes' WHEN l_discount < 0.1 THEN 'No' END", ""),
    "consumer_complaint_narrative": ("CAST(NULL AS STRING)", ""),
}
# Stand-ins for what text and models would add.
EXTRA_FIELDS = {
    "text_group": ("l_orderkey", ""),
    "narrative_words": ("CAST(l_quantity AS INT)", ""),
    "bulk": ("CAST(l_quantity >= 40 AS INT)", ""),
    "taxed": ("CAST(l_tax >= 0.07 AS INT)", ""),
    "listed": ("CAST(l_discount < 0.02 AS INT)", ""),
    "opened": ("CAST(l_linestatus = 'O' AS INT)", ""),
    "first_line": ("CAST(l_linenumber = 1 AS INT)", ""),
    "pricey": ("CAST(l_extendedprice >= 90000 AS INT)", ""),
    "theme": ("p_brand", "p"),
    "tone_units": ("CAST(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE"
                   " (l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7) % 20001 - 10000 END AS INT)", ""),
    "h": ("l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 1299709", ""),
}


def lines(spark: SparkSession, sf: str, tables: str = "opc") -> DataFrame:
    """Raw extract from the star schema. Only the tables asked for are joined; columns that need
    others are null. nation and region have 25 and 5 rows at every scale."""
    t = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    df = spread(t("lineitem"), "l_orderkey")
    # parts first and orders with their customers in one, so lineitem moves twice at most, and last by its order
    if "p" in tables:
        df = df.join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    orders = t("orders")
    if "c" in tables:
        places = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        homes = t("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
        orders = orders.join(homes, F.col("o_custkey") == F.col("c_custkey"))
    if "o" in tables or "c" in tables:
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    present = set(tables) | ({"o"} if "c" in tables else set())
    cols = [
        F.expr(e if set(needs) <= present else "CAST(NULL AS STRING)").alias(name)
        for name, (e, needs) in {**RAW_FIELDS, **EXTRA_FIELDS}.items()
    ]
    return df.select(*cols)


def raw_lines(spark, sf, tables="opc") -> DataFrame:
    return lines(spark, sf, tables).select(*RAW_FIELDS)


def cases_rel(spark: SparkSession, sf: str, tables: str = "opc") -> DataFrame:
    """Clean structured cases: the ingest chain over `lines`."""
    df = map_labels(lines(spark, sf, tables), "product", "_short", PRODUCTS, strict="p" in tables)
    df = fill_defaults(df).withColumnRenamed("_short", "product")
    df = features.outcome_flags(df)
    df = features.date_features(df, WINDOW)
    df = features.segment_flags(df)
    df = features.geo_flags(df, STATE, METRO)
    return df.withColumn("sentiment", F.col("tone_units") / F.lit(10000.0))


def with_copies(df: DataFrame) -> DataFrame:
    return copies.mark_copies(df)


def with_company_group(df: DataFrame, n: int = 15) -> DataFrame:
    return fold_to_top(df, "company", n, S.OTHER_COMPANIES, "company_group")


def scored(spark: SparkSession, sf: str, tables: str = "p") -> DataFrame:
    """Cases with whole-number stand-ins for scores, confidence and routing prediction."""
    names = sorted(PRODUCTS.values())
    following = dict(zip(names, names[1:] + names[:1]))
    swap = F.create_map(*[F.lit(x) for pair in following.items() for x in pair])
    df = cases_rel(spark, sf, tables)
    h = F.col("h")
    df = df.withColumns({
        "score_u": h % 700000 + F.col("relief") * 300000,
        "conf_u": (h * 31) % 700000 + 300000,
    }).withColumn("correct", ((h * 17) % 1000000 < F.col("conf_u")).cast("int"))
    return df.withColumns({
        "relief_score": F.col("score_u") / F.lit(1e6),
        "route_confidence": F.col("conf_u") / F.lit(1e6),
        "pred": F.when(F.col("correct") == 1, F.col("product")).otherwise(swap[F.col("product")]),
    })


# md5 keys are even, so two hex digits give 256 even buckets; more digits suit more rows.
def case_bucket():
    return prefix_bucket("case_id", 2)


def cases_text(spark: SparkSession, sf: str) -> DataFrame:
    """Clean narrative cases from documents and labels (both keyed by doc_id)."""
    t = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    df = spread(t("documents"), "doc_id").join(t("labels"), "doc_id", "left").selectExpr(
        "doc_id AS complaint_id", "lang AS product", "source AS company",
        "text AS consumer_complaint_narrative",
        "CASE WHEN toxic = 1 THEN 'Closed with monetary relief' WHEN quality = 1 THEN"
        " 'Closed with non-monetary relief' WHEN quality = 0 THEN 'Closed with explanation' END"
        " AS company_response_to_consumer",
        "CAST(NULL AS STRING) AS sub_product", "CAST(NULL AS STRING) AS sub_issue",
        "CAST(NULL AS STRING) AS state", "CAST(NULL AS STRING) AS zip_code",
        "CAST(NULL AS STRING) AS tags", "CAST(NULL AS STRING) AS timely_response",
    )
    df = fill_defaults(map_labels(df, "product", "_short", LANGUAGES)).withColumnRenamed("_short", "product")
    return features.text_features(features.outcome_flags(df))


def stored_text(spark: SparkSession, sf: str) -> DataFrame:
    """The clean narrative table, written once: a filter on a derived column (word count, copies)
    then reads the column instead of cleaning the text again."""
    return cut(cases_text(spark, sf))


# ------------------------------------------------------------------------------------
# The same in SQL
# ------------------------------------------------------------------------------------
def _product_case(column: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {whens} END"


CASES = f"""
WITH base AS (
  SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                       strftime(l_shipdate, '%Y-%m-%d'))) AS case_id,
         CAST(o_orderdate AS DATE) AS date_received, CAST(l_shipdate AS DATE) AS date_sent,
         p_type AS product_full, {_product_case('p_type', PRODUCTS)} AS product,
         coalesce(nullif(p_brand, 'Brand#11'), '(none)') AS sub_product,
         o_orderpriority AS issue, coalesce(nullif(l_linestatus, 'O'), '(none)') AS sub_issue,
         p_name AS company, CASE WHEN r_name = 'ASIA' THEN 'Unknown' ELSE r_name END AS state,
         CAST(770 + n_nationkey AS VARCHAR) AS zip3,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'Older American' WHEN 'MACHINERY' THEN 'Servicemember'
              WHEN 'AUTOMOBILE' THEN 'Older American, Servicemember' ELSE '' END AS tags,
         CASE WHEN l_returnflag <> 'R' THEN 'Closed with explanation' WHEN l_linestatus = 'F'
              THEN 'Closed with monetary relief' ELSE 'Closed with non-monetary relief' END AS company_response,
         CAST(l_discount < 0.09 AS INT) AS timely,
         CAST(l_returnflag = 'R' AS INT) AS relief,
         CAST(l_returnflag = 'R' AND l_linestatus = 'F' AS INT) AS monetary_relief,
         strftime(o_orderdate, '%Y-%m') AS month,
         CAST(date_diff('day', o_orderdate, l_shipdate) AS INT) AS days_to_company,
         CAST(strftime(o_orderdate, '%Y-%m') BETWEEN '{WINDOW[0]}' AND '{WINDOW[1]}' AS INT) AS complete_month,
         CAST(c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AS INT) AS older_american,
         CAST(c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') AS INT) AS servicemember,
         CAST(r_name = 'AMERICA' AS INT) AS in_region,
         CAST(r_name = 'AMERICA' AND n_nationkey IN (1, 6) AS INT) AS in_metro,
         l_orderkey AS text_group, CAST(l_quantity AS INT) AS narrative_words,
         CAST(l_quantity >= 40 AS INT) AS bulk, CAST(l_tax >= 0.07 AS INT) AS taxed,
         CAST(l_discount < 0.02 AS INT) AS listed, CAST(l_linestatus = 'O' AS INT) AS opened,
         CAST(l_linenumber = 1 AS INT) AS first_line, CAST(l_extendedprice >= 90000 AS INT) AS pricey,
         p_brand AS theme,
         CAST(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE
              (l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7) % 20001 - 10000 END AS INT) AS tone_units,
         l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 1299709 AS h
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
),
top15 AS (SELECT company FROM base GROUP BY company ORDER BY count(*) DESC, company LIMIT 15),
cases AS (
  SELECT *, tone_units / 10000.0::DOUBLE AS sentiment,
         count(*) OVER (PARTITION BY text_group) AS dup_count,
         CAST(count(*) OVER (PARTITION BY text_group) > 1 AS INT) AS is_duplicate_text,
         CASE WHEN company IN (SELECT company FROM top15) THEN company
              ELSE 'All other companies' END AS company_group
  FROM base
)"""

_NAMES = sorted(PRODUCTS.values())
SCORED = CASES + f""",
marks AS (
  SELECT *, h % 700000 + 300000 * relief AS score_u, 300000 + (h * 31) % 700000 AS conf_u FROM cases
),
scored AS (
  SELECT *, score_u / 1e6::DOUBLE AS relief_score, conf_u / 1e6::DOUBLE AS route_confidence,
         CAST((h * 17) % 1000000 < conf_u AS INT) AS correct,
         CASE WHEN (h * 17) % 1000000 < conf_u THEN product ELSE
           {_product_case('product', dict(zip(_NAMES, _NAMES[1:] + _NAMES[:1])))} END AS pred
  FROM marks
)"""

CLEANED = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  lower(coalesce(text, '')), 'x{2,}', ' ', 'g'), '\{\$[\d,\.]+\}', ' dollaramount ', 'g'),
  '[^a-z\s'']', ' ', 'g'), '\s+', ' ', 'g'))"""

TEXTS = f"""
WITH base AS (
  SELECT documents.doc_id AS case_id, coalesce(text, '') AS narrative,
         {_product_case('lang', LANGUAGES)} AS product, trim(source) AS company,
         CASE WHEN toxic = 1 THEN 'Closed with monetary relief' WHEN quality = 1 THEN
              'Closed with non-monetary relief' WHEN quality = 0 THEN 'Closed with explanation' END AS company_response,
         CAST(coalesce(toxic = 1 OR quality = 1, false) AS INT) AS relief,
         CAST(coalesce(toxic = 1, false) AS INT) AS monetary_relief,
         {CLEANED} AS narrative_clean
  FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id
),
cases AS (
  SELECT *, md5(narrative_clean) AS text_group,
         CASE WHEN narrative_clean = '' THEN 0 ELSE len(string_split(narrative_clean, ' ')) END AS narrative_words,
         count(*) OVER (PARTITION BY md5(narrative_clean)) AS dup_count,
         CAST(count(*) OVER (PARTITION BY md5(narrative_clean)) > 1 AS INT) AS is_duplicate_text
  FROM base
)"""
