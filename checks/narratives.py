"""Terms, vocabulary, phrases, tone and excerpts over the documents."""
from pyspark.sql import functions as F

from caseloom import settings as S
from caseloom.functions import text as X
from caseloom.operators import copies, excerpts, phrases, tone, vocabulary as V
from caseloom.plans.lineage import cut
from checks.adapters import TEXTS, cases_text, stored_text, with_copies
from checks.registry import query

STOP = sorted(set(S.DOMAIN_STOP_WORDS) | set("the and of to in is that it was for on with this as de la le que".split()))
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
TOKENS = TEXTS + """,
words AS (SELECT case_id, product, company, relief, is_duplicate_text, text_group,
                 regexp_extract_all(narrative_clean, '[a-z]{2,}') AS w FROM cases),
kept AS (SELECT * REPLACE (list_filter(w, lambda x: NOT list_contains(""" + STOP_SQL + """, x)) AS w) FROM words),
grams AS (SELECT * EXCLUDE (w), list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
          FROM kept)"""


@query("t1_tokens", TOKENS + """
SELECT case_id, CAST(unnest(range(0, len(w))) AS INT) AS pos, unnest(w) AS token FROM words""")
def tokens(spark, sf):
    return cases_text(spark, sf).select(
        "case_id", F.posexplode(X.tokens(F.col("narrative_clean"))).alias("pos", "token"))


@query("t2_stop_words", TOKENS + """
SELECT case_id, CAST(unnest(range(0, len(w))) AS INT) AS pos, unnest(w) AS token FROM kept""")
def stop_words(spark, sf):
    return cases_text(spark, sf).select(
        "case_id", F.posexplode(X.tokens(F.col("narrative_clean"), STOP)).alias("pos", "token"))


COUNTS = """,
counts AS (SELECT case_id, term, count(*) AS tf FROM (SELECT case_id, unnest(g) AS term FROM grams) GROUP BY ALL)"""


@query("t3_ngrams", TOKENS + COUNTS + " SELECT * FROM counts")
def ngrams(spark, sf):
    return V.term_counts(cases_text(spark, sf), stop=STOP)


def _vocabulary(counts: str, docs: str) -> str:
    return f""",
vocab AS (
  SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INT) AS idx, total, df,
         ln((1 + (SELECT count(*) FROM {docs})) / CAST(1 + df AS DOUBLE)) + 1 AS idf
  FROM (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM {counts} GROUP BY term
        HAVING count(*) >= 10 AND count(*) <= 0.4 * (SELECT count(*) FROM {docs})
        ORDER BY total DESC, term LIMIT 3000))"""


@query("t4_vocabulary", TOKENS + COUNTS + _vocabulary("counts", "cases") + """
SELECT term, idx, total, df, round(idf, 9) AS idf FROM vocab""")
def vocabulary(spark, sf):
    df = cases_text(spark, sf)
    return V.vocabulary(V.term_counts(df, stop=STOP), df, 10, 0.4, 3000).withColumn("idf", F.round("idf", 9))


TFIDF = """,
raws AS (SELECT case_id, idx, (1 + ln(tf)) * idf AS raw FROM counts JOIN vocab USING (term))
SELECT case_id, idx, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY case_id)), 9) AS weight FROM raws"""


@query("t5_tfidf", TOKENS + COUNTS + _vocabulary("counts", "cases") + TFIDF)
def tfidf(spark, sf):
    terms = V.term_table(cases_text(spark, sf), stop=STOP)
    counts = V.counts_of(terms)
    return V.tfidf(counts, V.vocabulary(counts, terms, 10, 0.4, 3000)).withColumn("weight", F.round("weight", 9))


@query("t6_transform_new_text", TOKENS + COUNTS + """,
uniques AS (SELECT min(case_id) AS case_id FROM cases GROUP BY text_group),
fit_counts AS (SELECT * FROM counts SEMI JOIN uniques USING (case_id))"""
       + _vocabulary("fit_counts", "uniques") + TFIDF)
def transform_new_text(spark, sf):
    """Vocabulary from one case per text, applied to all cases."""
    terms = V.term_table(cases_text(spark, sf), stop=STOP, carry=("text_group",))
    unique = copies.first_per_group(terms)
    vocab = V.vocabulary(unique.select(F.inline("terms")), unique, 10, 0.4, 3000)
    entries = F.arrays_zip(F.col("indices").alias("idx"), F.col("values").alias("weight"))
    return V.vectors(terms, vocab).select("case_id", F.inline(entries)).withColumn("weight", F.round("weight", 9))


PHRASES = TOKENS + """,
uses AS (SELECT DISTINCT case_id, product, company, relief, is_duplicate_text, unnest(g) AS phrase FROM grams),
frequent AS (
  SELECT phrase, count(*) AS cases, CAST(sum(relief) AS DOUBLE) / count(*) AS relief_rate,
         CAST(sum(is_duplicate_text) AS DOUBLE) / count(*) AS template_share
  FROM uses GROUP BY phrase HAVING count(*) >= 20),
strata AS (SELECT product, count(*) AS alln, sum(relief) AS allr FROM cases GROUP BY product),
expected AS (
  SELECT phrase, round(sum(n * (CASE WHEN alln > n THEN CAST(allr - r AS DOUBLE) / (alln - n)
                                ELSE CAST(allr AS DOUBLE) / alln END)) / sum(n), 9) AS expected_rate
  FROM (SELECT phrase, product, count(*) AS n, sum(relief) AS r FROM uses GROUP BY ALL) JOIN strata USING (product)
  GROUP BY phrase),
companies AS (
  SELECT phrase, max(n) AS top_n FROM (SELECT phrase, company, count(*) AS n FROM uses GROUP BY ALL) GROUP BY phrase),
gaps AS (
  SELECT phrase, cases, relief_rate, expected_rate, CAST(top_n AS DOUBLE) / cases AS top_company_share,
         template_share, (relief_rate - expected_rate) * 100 AS gap_pts
  FROM frequent JOIN expected USING (phrase) JOIN companies USING (phrase)
  WHERE CAST(top_n AS DOUBLE) / cases <= 0.35 AND template_share <= 0.30)"""


def gaps(spark, sf):
    return phrases.phrase_gaps(with_copies(stored_text(spark, sf)), 20, STOP)


@query("t11_phrase_gaps", PHRASES + " SELECT * FROM gaps")
def phrase_gaps(spark, sf):
    return gaps(spark, sf)


_stem = lambda w: "CASE " + " ".join(
    f"WHEN {w} LIKE '%{s}' AND length({w}) - {len(s)} >= 3 THEN left({w}, length({w}) - {len(s)})"
    for s in ("ing", "ed", "es", "s", "e")) + f" ELSE {w} END"


@query("t12_stem", TOKENS + f"""
SELECT word, {_stem('word')} AS stem FROM (SELECT DISTINCT unnest(w) AS word FROM words)""")
def stems(spark, sf):
    words = cases_text(spark, sf).select(F.explode(X.tokens(F.col("narrative_clean"))).alias("word")).distinct()
    return words.select("word", X.stem(F.col("word")).alias("stem"))


PICKS = PHRASES.replace("WITH base", "WITH RECURSIVE base", 1) + f""",
ranked AS (
  SELECT 'more relief than expected' AS direction, phrase, row_number() OVER (ORDER BY gap_pts DESC, phrase) AS place FROM gaps UNION ALL
  SELECT 'less relief than expected', phrase, row_number() OVER (ORDER BY gap_pts, phrase) FROM gaps),
stemmed AS (
  SELECT direction, place, phrase, list(DISTINCT {_stem('word')}) AS stems
  FROM (SELECT *, unnest(string_split(phrase, ' ')) AS word FROM ranked) GROUP BY ALL),
walk AS (
  SELECT DISTINCT direction, CAST(0 AS BIGINT) AS step, CAST([] AS VARCHAR[]) AS used, CAST([] AS VARCHAR[]) AS picks FROM ranked
  UNION ALL
  SELECT w.direction, s.place, CASE WHEN list_has_any(w.used, s.stems) THEN w.used ELSE w.used || s.stems END,
         CASE WHEN list_has_any(w.used, s.stems) THEN w.picks ELSE list_append(w.picks, s.phrase) END
  FROM walk w JOIN stemmed s ON s.direction = w.direction AND s.place = w.step + 1 WHERE len(w.picks) < 12),
picked AS (SELECT direction, unnest(picks) AS phrase FROM (SELECT direction, last(picks ORDER BY step) AS picks FROM walk GROUP BY direction))
SELECT gaps.*, direction FROM picked JOIN gaps USING (phrase)"""


@query("t13_phrase_picks", PICKS)
def phrase_picks(spark, sf):
    return phrases.phrase_table(cut(gaps(spark, sf)), 12)


SENTENCES = TEXTS + r""",
pieces AS (
  SELECT case_id, list_filter(string_split_regex(regexp_replace(regexp_replace(narrative, 'X{2,}', '', 'g'),
         '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'),
         lambda s: len(regexp_extract_all(s, '\S+')) >= 3) AS s
  FROM cases)"""


@query("t14_sentences", SENTENCES + """
SELECT case_id, CAST(unnest(range(0, len(s))) AS INT) AS pos, unnest(s) AS sentence FROM pieces""")
def sentences(spark, sf):
    return tone.case_sentences(cases_text(spark, sf))


# Words with valences for the driver's documents; any (token, valence) table will do.
LEXICON = {
    "the": 0.5, "good": 2.0, "great": 3.0, "worthless": -2.5, "trash": -2.0, "disgusting": -3.0, "whor": -3.5,
    "was": -0.5, "that": 0.5, "this": 1.0, "idiot": -2.5, "hate": -3.0, "license": 1.0, "de": -0.5, "que": 0.5,
    "der": 0.5, "und": -1.0, "est": 1.5, "los": -1.5, "del": 1.0, "free": 2.0, "error": -1.5,
}
LEXICON_SQL = "lexicon(token, valence) AS (VALUES " + ", ".join(
    f"('{t}', {v}::DOUBLE)" for t, v in LEXICON.items()) + ")"
SCORES = SENTENCES + ", " + LEXICON_SQL + r""",
numbered AS (SELECT case_id, CAST(unnest(range(0, len(s))) AS INT) AS pos, unnest(s) AS sentence FROM pieces),
spoken AS (SELECT case_id, pos, unnest(regexp_extract_all(lower(sentence), '\p{L}+(?:''\p{L}+)*')) AS token FROM numbered),
sums AS (SELECT case_id, pos, sum(valence) AS s FROM spoken JOIN lexicon USING (token) GROUP BY ALL),
units AS (SELECT case_id, pos, CAST(round(10000 * coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15)) AS BIGINT) AS u
          FROM numbered LEFT JOIN sums USING (case_id, pos)),
tones AS (
  SELECT cases.case_id, coalesce(sum(u), 0) AS u, count(u) AS n, count(*) FILTER (WHERE u <= -500) AS neg
  FROM cases LEFT JOIN units ON cases.case_id = units.case_id GROUP BY cases.case_id)"""


def lexicon(spark):
    return spark.createDataFrame(list(LEXICON.items()), "token string, valence double")


@query("t15_sentence_scores", SCORES + " SELECT case_id, pos, u AS units FROM units")
def sentence_scores(spark, sf):
    return tone.sentence_scores(cases_text(spark, sf), lexicon(spark)).where(F.col("pos").isNotNull())


@query("t15_tone", SCORES + """
SELECT case_id, CASE WHEN n = 0 THEN 0 ELSE sign(u) * ((2 * abs(u) + n) // (2 * n)) / 10000e0 + 0e0 END AS sentiment,
       CASE WHEN n = 0 THEN 0 ELSE ((20000 * neg + n) // (2 * n)) / 10000e0 END AS negative_sentence_share FROM tones""")
def case_tone(spark, sf):
    return tone.tone(cases_text(spark, sf), lexicon(spark))


STRONG = TEXTS + """,
strong AS (
  SELECT *, ((case_id * 7919) % 10007) / 10007e0 AS theme_strength,
         CAST(row_number() OVER (PARTITION BY product ORDER BY (case_id * 7919) % 10007 DESC, case_id) AS INT) AS place
  FROM cases WHERE dup_count = 1 AND narrative_words BETWEEN 40 AND 90)"""


def themed(spark, sf):
    return with_copies(stored_text(spark, sf)).withColumns({
        "theme": F.col("product"), "theme_strength": (F.col("case_id") * 7919) % 10007 / F.lit(10007.0)})


@query("w6_strongest_per_theme", STRONG + """
SELECT product AS theme, place, case_id, theme_strength FROM strong WHERE place <= 300""")
def strongest(spark, sf):
    return excerpts.strongest(themed(spark, sf)).select("theme", "place", "case_id", "theme_strength")


@query("t16_excerpts", STRONG.replace("WITH base", "WITH RECURSIVE base", 1) + r""",
shown AS (
  SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS words, row_number() OVER (PARTITION BY product ORDER BY place) AS ord
  FROM (SELECT case_id, product, place, company_response, regexp_replace(trim(regexp_replace(narrative, '\s+', ' ', 'g')), '\{\$([\d,\.]+)\}', '$\1', 'g') AS text
        FROM strong WHERE place <= 300) WHERE length(text) <= 520),
walk AS (
  SELECT DISTINCT product, CAST(0 AS BIGINT) AS step, CAST([] AS VARCHAR[][]) AS kept, CAST([] AS BIGINT[]) AS ids FROM shown
  UNION ALL
  SELECT product, ord, CASE WHEN alike THEN kept ELSE list_append(kept, words) END, CASE WHEN alike THEN ids ELSE list_append(ids, case_id) END
  FROM (SELECT w.product, s.ord, w.kept, w.ids, s.words, s.case_id, len(list_filter(w.kept,
               lambda k: 2 * len(list_intersect(k, s.words)) > len(list_distinct(k || s.words)))) > 0 AS alike
        FROM walk w JOIN shown s ON s.product = w.product AND s.ord = w.step + 1 WHERE len(w.ids) < 2)),
picked AS (SELECT product AS theme, unnest(ids) AS case_id FROM (SELECT product, last(ids ORDER BY step) AS ids FROM walk GROUP BY product))
SELECT theme, case_id, product, company_response AS outcome, text FROM picked JOIN shown USING (case_id)""")
def excerpt_picks(spark, sf):
    return excerpts.pick_excerpts(themed(spark, sf))
