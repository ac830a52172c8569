"""Topics and models over the documents. Fits have no SQL; what their optimum must satisfy has, and tests/ check their properties."""
from pyspark.sql import functions as F

from caseloom.operators import copies, features, metrics as M, models, ranking, splits, topics, vocabulary as V
from caseloom.plans.lineage import cut
from checks.adapters import CASES, PRODUCTS, TEXTS, cases_rel, cases_text
from checks.analytics import TEXT_SIGNALS, TEXT_SIGNALS_SQL
from checks.evaluation import HOLDOUT
from checks.narratives import STOP
from checks.registry import query

SEEDS = [
    ("French", ["et", "elle", "des"]), ("German", ["der", "die", "und"]),
    ("Spanish", ["los", "del", "el"]), ("English", ["are", "by", "from"]),
]


def topic_fit(spark, sf):
    """(cases, vectors of all cases, model), fitted to the different texts of five words or more."""
    df = cut(cases_text(spark, sf).select("case_id", "narrative_clean", "text_group", "narrative_words"))
    # first cases are marked before texts are taken apart: their terms are neither moved nor written again
    firsts = copies.first_per_group(df.select("case_id", "text_group")).select("case_id").distinct().withColumn("first", F.lit(True))
    terms = V.term_table(df.join(firsts, "case_id", "left"), stop=STOP, carry=("first", "narrative_words"))
    unique = terms.where("first AND narrative_words >= 5")
    vocab = cut(V.vocabulary(unique.select(F.inline("terms")), unique, 10, 0.7, 30_000))
    model = topics.fit_topics(V.vectors(unique, vocab), vocab, SEEDS)
    return terms, V.vectors(terms, vocab), model


@query("t7_topics")
def topic_components(spark, sf):
    return topic_fit(spark, sf)[2].components()


@query("t8_topic_drift")
def topic_drift(spark, sf):
    return topic_fit(spark, sf)[2].drift()


@query("t9_top_terms")
def top_terms(spark, sf):
    return topic_fit(spark, sf)[2].top_terms()


@query("t10_assignments")
def assignments(spark, sf):
    df, vectors, model = topic_fit(spark, sf)
    return model.assign(df, vectors)


# ---- topics whose optimum is known: one word list for each kind of part -----------------------
ENDINGS = ("ax", "bo", "cu", "di", "en", "fa")
KINDS = sorted(PRODUCTS)
KIND_SEEDS = [(f"{k} parts", [k.lower() + e for e in ENDINGS[:2]]) for k in KINDS]
# The cases of a kind are multiples of one unit vector v, so its topic is v / w and each case has the weight w, the
# mean of v over the anchors that the topic starts from.
KIND_TOPICS = CASES + f""",
kinds AS (SELECT product_full AS kind, count(*) AS df, sum(count(*)) OVER () AS n FROM cases GROUP BY product_full),
raws AS (
  SELECT CAST(list_position({KINDS}, kind) - 1 AS INT) AS topic_id, kind, i, lower(kind) || ({list(ENDINGS)})[i] AS term,
         (1 + ln(1 + (i - 1) % 3)) * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS raw
  FROM kinds, range(1, {len(ENDINGS)} + 1) r(i)),
units AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY kind)) AS v FROM raws),
topics AS (SELECT *, v / w AS weight FROM (SELECT *, sum(v) FILTER (WHERE i <= 2) OVER (PARTITION BY kind) / 2 AS w FROM units)),
seeds AS (SELECT topic_id, kind || ' parts' AS theme, string_agg(term, ', ' ORDER BY i) FILTER (WHERE i <= 2) AS seed_terms,
                 string_agg(term, ', ' ORDER BY round(weight, 9) DESC, term) AS top_terms FROM topics GROUP BY ALL)"""


def kind_fit(spark, sf):
    words = [F.concat(F.lower("product_full"), F.lit(e)) for i, e in enumerate(ENDINGS) for _ in range(1 + i % 3)]
    df = cut(cases_rel(spark, sf, "p").select("case_id", F.concat_ws(" ", F.lit("all"), *words).alias("narrative_clean")))
    terms = V.term_table(df, n=1)
    vocab = cut(V.vocabulary(terms.select(F.inline("terms")), terms, 1, 0.7, 1000))
    vectors = cut(V.vectors(terms, vocab))
    model = topics.fit_topics(vectors, vocab, KIND_SEEDS, written=True)
    if not model.converged:
        raise RuntimeError("Topics of separate word lists have not come to rest")
    return df, vectors, model


@query("t7_kind_topics", KIND_TOPICS + " SELECT topic_id, term, round(weight, 6) AS weight FROM topics")
def kind_topics(spark, sf):
    return kind_fit(spark, sf)[2].components().withColumn("weight", F.round("weight", 6))


@query("t8_kind_drift", KIND_TOPICS + """
SELECT topic_id, theme, CAST(2 AS BIGINT) AS anchors, CAST(2 AS BIGINT) AS kept, false AS drifted FROM seeds""")
def kind_drift(spark, sf):
    return kind_fit(spark, sf)[2].drift()


@query("t9_kind_terms", KIND_TOPICS + " SELECT topic_id, theme, seed_terms, top_terms FROM seeds")
def kind_terms(spark, sf):
    model = kind_fit(spark, sf)[2]
    model.H = model.H.round(9)      # equal weights are equal to the last digit
    return model.top_terms()


@query("t10_kind_assignments", KIND_TOPICS + """
SELECT case_id, topic_id, seeds.theme, round(w, 4) AS theme_strength FROM cases
JOIN (SELECT DISTINCT kind, topic_id, w FROM topics) ON kind = product_full JOIN seeds USING (topic_id)""")
def kind_assignments(spark, sf):
    df, vectors, model = kind_fit(spark, sf)
    return model.assign(df, vectors)


# ---- models --------------------------------------------------------------------------------
CATEGORIES = ("product", "company_model", "sub_product", "sub_issue", "state")
NUMBERS = (*TEXT_SIGNALS, "log_words")
OPTIONS = {"categories": CATEGORIES, "numbers": NUMBERS}
TEXT_KEY = 65536
FOLDS = 5

MODEL_CASES = TEXTS + HOLDOUT + f""",
top100 AS (SELECT company FROM cases GROUP BY company ORDER BY count(*) DESC, company LIMIT 100),
model_cases AS (
  SELECT case_id, product, CASE WHEN company IN (SELECT company FROM top100) THEN company ELSE 'Other' END AS company_model,
         '(none)' AS sub_product, '(none)' AS sub_issue, 'Unknown' AS state, relief, place, g,
         CAST(place <= CAST(ceil(g / 5.0) AS BIGINT) AS INT) AS in_holdout, {TEXT_SIGNALS_SQL},
         ln(1 + narrative_words) / ln(1 + max(narrative_words) OVER ()) AS log_words
  FROM cases JOIN order_of_groups USING (text_group)),
levels AS (
  SELECT name, level, CAST(dense_rank() OVER (ORDER BY name, CASE WHEN n >= 20 THEN level END NULLS LAST) - 1 AS INT) AS idx
  FROM (SELECT name, level, count(*) AS n FROM (
    {" UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS level FROM model_cases WHERE in_holdout = 0" for c in CATEGORIES)}) GROUP BY ALL))"""


def model_cases(spark, sf):
    """Cases with hold-out flag and model inputs, written once per call."""
    df = features.signal_flags(cases_text(spark, sf), TEXT_SIGNALS)
    df = ranking.fold_to_top(df, "company", 100, "Other", "company_model")
    df = features.scaled_log_words(df)
    return cut(splits.group_holdout(df, "text_group", 0.2, 42))


def routed(df):
    """(router, terms of all cases, routes of the hold-out)."""
    terms = V.term_table(df, carry=("in_holdout",))
    train, test = terms.where("in_holdout = 0"), terms.where("in_holdout = 1")
    router = models.fit_router(df.where("in_holdout = 0"), terms=train)
    return router, terms, router.predict(df.where("in_holdout = 1"), "product", terms=test)


@query("m3_routing_report")
def routing_report(spark, sf):
    return M.class_report(cut(routed(model_cases(spark, sf))[2]), "product", "route_pred")


@query("m3_class_balance", MODEL_CASES + """
SELECT product AS label, count(*) AS cases, CAST(count(*) AS DOUBLE) AS predicted FROM model_cases WHERE in_holdout = 0 GROUP BY product""")
def class_balance(spark, sf):
    """At the optimum the predicted probabilities of a class add up to its training rows."""
    df = model_cases(spark, sf).where("in_holdout = 0")
    return models.fit_router(df).balance().withColumn("predicted", F.round("predicted", 1))


@query("m4_routes")
def routes(spark, sf):
    return routed(model_cases(spark, sf))[2]


@query("d6_category_levels", MODEL_CASES + " SELECT * FROM levels")
def category_levels(spark, sf):
    return models.category_levels(model_cases(spark, sf).where("in_holdout = 0"), CATEGORIES)


@query("m5_design", MODEL_CASES + f""",
long AS ({" UNION ALL ".join(f"SELECT case_id, '{c}' AS name, {c} AS level FROM model_cases" for c in CATEGORIES)}),
fields AS (SELECT case_id, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS fields FROM long JOIN levels USING (name, level) GROUP BY case_id)
SELECT case_id, coalesce(fields, '') AS fields,
       concat_ws(',', {", ".join(f"CAST(round(1e6 * {c}) AS BIGINT)" for c in NUMBERS)}) AS numbers
FROM model_cases LEFT JOIN fields USING (case_id)""")
def design_matrix(spark, sf):
    df = model_cases(spark, sf)
    train = df.where("in_holdout = 0")
    levels = models.category_levels(train, CATEGORIES)
    vocab = spark.createDataFrame([], "term string, idx int, total long, df long, idf double")
    parts = models.design_of(levels, vocab, CATEGORIES, NUMBERS).fields(df)
    millionths = F.transform("numbers", lambda x: F.round(x * 1e6).cast("long").cast("string"))
    return parts.select("case_id", F.array_join(F.transform("fields", lambda i: i.cast("string")), ",").alias("fields"),
                        F.array_join(millionths, ",").alias("numbers"))


@query("m5_text_terms", MODEL_CASES + """,
grams AS (SELECT case_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
          FROM (SELECT case_id, regexp_extract_all(narrative_clean, '[a-z]{2,}') AS w FROM cases)),
train AS (SELECT case_id FROM model_cases WHERE in_holdout = 0),
counts AS (SELECT case_id, term, count(*) AS tf FROM grams GROUP BY ALL),
vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, ln((1 + (SELECT count(*) FROM train)) / CAST(1 + df AS DOUBLE)) + 1 AS idf
          FROM (SELECT term, sum(tf) AS total, count(*) AS df FROM counts SEMI JOIN train USING (case_id) GROUP BY term
                HAVING count(*) >= 5 AND count(*) <= 0.5 * (SELECT count(*) FROM train) ORDER BY total DESC, term LIMIT 50000)),
raws AS (SELECT case_id, idx, (1 + ln(tf)) * idf AS raw FROM counts JOIN vocab USING (term))
SELECT case_id, count(*) AS terms, CAST(sum(idx) AS BIGINT) AS at, round(max(raw) / sqrt(sum(raw * raw)), 9) AS largest FROM raws GROUP BY case_id""")
def text_terms(spark, sf):
    """What the text adds to each case under the vocabulary of the training cases."""
    df = model_cases(spark, sf)
    terms = V.term_table(df, carry=("in_holdout",))
    design = models.fit_design(df.where("in_holdout = 0"), terms=terms.where("in_holdout = 0"), **OPTIONS)
    parts = design.parts(df, terms=terms).where(F.size("indices") > 0)
    at = F.aggregate("indices", F.lit(0).cast("long"), lambda s, i: s + i)
    return parts.select("case_id", F.size("indices").cast("long").alias("terms"), at.alias("at"),
                        F.round(F.array_max("values"), 9).alias("largest"))


@query("m6_model_comparison")
def model_comparison(spark, sf):
    df = model_cases(spark, sf)
    bucket = ranking.id_bucket("case_id", TEXT_KEY)
    scored = models.compare_variants(df.where("in_holdout = 0"), df.where("in_holdout = 1"), bucket, **OPTIONS)
    rows = None
    for name, table in scored.items():
        row = M.model_row(cut(table), name, "relief", "relief_score", "case_id", bucket)
        rows = row if rows is None else rows.unionByName(row)
    return rows


def balance(spark, names, optima):
    rows = [(name, n, sum(o.counts), round(p, 1)) for name, o in zip(names, optima) for n, p in [(o.counts[1], o.predicted[1])]]
    return spark.createDataFrame(rows, "fit string, relief long, cases long, predicted double")


@query("m6_class_balance", MODEL_CASES + """
SELECT unnest(['fields', 'text', 'both']) AS fit, CAST(sum(relief) AS BIGINT) AS relief, count(*) AS cases,
       CAST(sum(relief) AS DOUBLE) AS predicted FROM model_cases WHERE in_holdout = 0""")
def variant_balance(spark, sf):
    df, optima = model_cases(spark, sf), []
    models.compare_variants(df.where("in_holdout = 0"), df.where("in_holdout = 1"), None, optima=optima, **OPTIONS)
    return balance(spark, ("fields", "text", "both"), optima)


@query("m7_out_of_fold")
def out_of_fold(spark, sf):
    return models.out_of_fold(model_cases(spark, sf).drop("in_holdout"), FOLDS, **OPTIONS)


@query("m7_class_balance", MODEL_CASES + """,
sizes AS (SELECT max(g) // 5 AS small, max(g) % 5 AS extra FROM order_of_groups),
folds AS (SELECT relief, CASE WHEN place <= extra * (small + 1) THEN (place - 1) // (small + 1)
                              ELSE extra + (place - 1 - extra * (small + 1)) // small END AS fold FROM model_cases, sizes)
SELECT CAST(k AS VARCHAR) AS fit, CAST(sum(relief) AS BIGINT) AS relief, count(*) AS cases, CAST(sum(relief) AS DOUBLE) AS predicted
FROM folds, range(5) r(k) WHERE fold <> k GROUP BY k""")
def fold_balance(spark, sf):
    optima = []
    models.out_of_fold(model_cases(spark, sf).drop("in_holdout"), FOLDS, optima=optima, **OPTIONS)
    return balance(spark, map(str, range(FOLDS)), optima)


@query("m16_score_table")
def score_table(spark, sf):
    df = model_cases(spark, sf)
    _, terms, held = routed(df)
    scores = models.out_of_fold(df, FOLDS, terms=terms, **OPTIONS)
    return models.score_table(df, scores, held, ranking.id_bucket("case_id", TEXT_KEY))
