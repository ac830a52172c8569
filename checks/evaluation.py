"""Group splits and model evaluation on whole-number stand-in scores."""
from pyspark.sql import functions as F

from caseloom.operators import metrics as M, ranking, splits
from checks.adapters import CASES, PRODUCTS, SCORED, TEXTS, case_bucket, cases_rel, cases_text, scored
from checks.registry import query, rat

LABELS = sorted(PRODUCTS.values())


# ---- splits -------------------------------------------------------------------------------
HOLDOUT = """,
order_of_groups AS (
  SELECT text_group, row_number() OVER (ORDER BY md5(concat('42|', text_group))) AS place, count(*) OVER () AS g
  FROM (SELECT DISTINCT text_group FROM cases))
"""


@query("m1_group_holdout", CASES + HOLDOUT + """
SELECT case_id, CAST(place <= CAST(ceil(g / 5.0) AS BIGINT) AS INT) AS in_holdout
FROM cases JOIN order_of_groups USING (text_group)""")
def group_holdout(spark, sf):
    df = cases_rel(spark, sf, "").select("case_id", "text_group")
    return splits.group_holdout(df, "text_group", 0.2, 42).select("case_id", "in_holdout")


@query("m1_text_holdout", TEXTS + HOLDOUT + """
SELECT case_id, CAST(place <= CAST(ceil(g / 5.0) AS BIGINT) AS INT) AS in_holdout
FROM cases JOIN order_of_groups USING (text_group)""")
def text_holdout(spark, sf):
    df = cases_text(spark, sf).select("case_id", "text_group")
    return splits.group_holdout(df, "text_group", 0.2, 42).select("case_id", "in_holdout")


@query("m2_group_folds", CASES + HOLDOUT + """
, sizes AS (SELECT max(g) // 5 AS small, max(g) % 5 AS extra FROM order_of_groups)
SELECT case_id, CAST(CASE WHEN place <= extra * (small + 1) THEN (place - 1) // (small + 1)
       ELSE extra + (place - 1 - extra * (small + 1)) // small END AS INT) AS fold
FROM cases JOIN order_of_groups USING (text_group), sizes""")
def group_folds(spark, sf):
    df = cases_rel(spark, sf, "").select("case_id", "text_group")
    return splits.group_folds(df, "text_group", 5, 42).select("case_id", "fold")


# ---- routing ------------------------------------------------------------------------------
REPORT = """,
cells AS (SELECT product AS y, pred, count(*) AS n FROM scored GROUP BY ALL),
labels AS (SELECT y AS label FROM cells UNION SELECT pred FROM cells),
per_class AS (
  SELECT label, coalesce((SELECT sum(n) FROM cells WHERE y = label), 0) AS support,
         coalesce((SELECT sum(n) FROM cells WHERE pred = label), 0) AS called,
         coalesce((SELECT sum(n) FROM cells WHERE y = label AND pred = label), 0) AS hits FROM labels),
prf AS (
  SELECT label, coalesce(CAST(hits AS DOUBLE) / nullif(called, 0), 0) AS precision,
         coalesce(CAST(hits AS DOUBLE) / nullif(support, 0), 0) AS recall,
         coalesce(CAST(2 * hits AS DOUBLE) / nullif(called + support, 0), 0) AS f1,
         CAST(support AS DOUBLE) AS support FROM per_class),
acc AS (SELECT CAST(sum(CASE WHEN y = pred THEN n END) AS DOUBLE) / sum(n) AS a FROM cells),
report AS (
  SELECT * FROM prf
  UNION ALL SELECT 'accuracy', a, a, a, a FROM acc
  UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support) FROM prf
  UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9),
         round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), sum(support) FROM prf)"""


@query("m8_class_report", SCORED + REPORT + " SELECT * FROM report")
def class_report(spark, sf):
    return M.class_report(scored(spark, sf), "product", "pred")


_matrix = ", ".join(f"CAST(count(*) FILTER (WHERE pred = '{v}') AS DOUBLE) / count(*) AS \"{v}\"" for v in LABELS)


@query("m9_confusion", SCORED + f" SELECT product AS actual, {_matrix} FROM scored GROUP BY product")
def confusion(spark, sf):
    return M.confusion(scored(spark, sf), "product", "pred", LABELS)


SHARES = """,
shares AS (SELECT product AS actual, pred AS predicted,
                  CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY product) AS share
           FROM scored GROUP BY product, pred),
worst AS (SELECT * FROM shares WHERE actual <> predicted ORDER BY share DESC, actual, predicted LIMIT 4)"""


@query("w7_top_confusions", SCORED + SHARES + " SELECT * FROM worst")
def top_confusions(spark, sf):
    return M.top_confusions(M.confusion_shares(scored(spark, sf), "product", "pred"), 4)


CURVE = """,
curve AS (
  SELECT t / 100.0::DOUBLE AS threshold,
         CAST(count(*) FILTER (WHERE conf_u >= t * 10000) AS DOUBLE) / count(*) AS coverage,
         CAST(sum(correct) FILTER (WHERE conf_u >= t * 10000) AS DOUBLE)
           / nullif(count(*) FILTER (WHERE conf_u >= t * 10000), 0) AS accuracy
  FROM scored, range(30, 100) steps(t) GROUP BY t)"""


@query("m10_automation_curve", SCORED + CURVE + " SELECT * FROM curve")
def automation_curve(spark, sf):
    return M.automation_curve(scored(spark, sf), "route_confidence", "correct")


@query("w8_first_threshold", SCORED + CURVE + """
SELECT * FROM curve WHERE accuracy >= 0.9 ORDER BY threshold LIMIT 1""")
def first_threshold(spark, sf):
    return M.first_threshold(M.automation_curve(scored(spark, sf), "route_confidence", "correct"), 0.9)


# ---- outcome scores ------------------------------------------------------------------------------
AUC = """(
  SELECT CAST(sum(pos * (2 * (below - neg) + neg)) AS DOUBLE) / (2 * sum(pos) * sum(neg))
  FROM (SELECT sum(relief) AS pos, sum(1 - relief) AS neg, sum(sum(1 - relief)) OVER (ORDER BY score_u) AS below
        FROM scored GROUP BY score_u))"""
AP = """(
  SELECT round(sum(pos * (CAST(tp AS DOUBLE) / n)) / sum(pos), 9)
  FROM (SELECT sum(relief) AS pos, sum(sum(relief)) OVER (ORDER BY score_u DESC) AS tp,
               sum(count(*)) OVER (ORDER BY score_u DESC) AS n FROM scored GROUP BY score_u))"""
LIFT = """
lifted AS (
  SELECT CAST(sum(relief) FILTER (WHERE r <= n * 2 // 10) AS DOUBLE) / sum(relief) AS capture_top20,
         CAST(sum(relief) FILTER (WHERE r <= n // 10) AS DOUBLE) / max(n // 10) AS precision_top10,
         CAST(sum(relief) AS DOUBLE) / max(n) AS base_rate
  FROM (SELECT relief, row_number() OVER (ORDER BY score_u DESC, case_id) AS r, count(*) OVER () AS n FROM scored))"""


@query("m11_roc_auc", SCORED + f" SELECT {AUC} AS roc_auc")
def roc_auc(spark, sf):
    return M.roc_auc(scored(spark, sf, ""), "relief", "relief_score")


@query("m12_average_precision", SCORED + f" SELECT {AP} AS average_precision")
def average_precision(spark, sf):
    return M.average_precision(scored(spark, sf, ""), "relief", "relief_score")


@query("m13_lift_stats", SCORED + "," + LIFT + """
SELECT capture_top20, precision_top10, precision_top10 / base_rate AS lift_top10, base_rate FROM lifted""")
def lift_stats(spark, sf):
    return M.lift_stats(scored(spark, sf, ""), "relief", "relief_score", "case_id", case_bucket())


@query("m6_model_row", SCORED + "," + LIFT + f"""
SELECT 'stand-in' AS model, capture_top20, precision_top10, precision_top10 / base_rate AS lift_top10, base_rate,
       {AUC} AS roc_auc, {AP} AS average_precision FROM lifted""")
def model_row(spark, sf):
    return M.model_row(scored(spark, sf, ""), "stand-in", "relief", "relief_score", "case_id", case_bucket())


DECILED = """,
deciled AS (
  SELECT *, CAST(greatest(1, ((row_number() OVER (ORDER BY score_u DESC, case_id) - 1) * 10 + count(*) OVER () - 2)
         // (count(*) OVER () - 1)) AS INT) AS decile FROM scored)"""
DECILES = """,
deciles AS (
  SELECT decile, count(*) AS cases, CAST(sum(relief) AS DOUBLE) / count(*) AS relief_rate,
         CAST(sum(score_u) AS DOUBLE) / count(*) / 1e6 AS avg_score,
         CAST(sum(sum(relief)) OVER (ORDER BY decile) AS DOUBLE) / sum(sum(relief)) OVER () AS cumulative_capture,
         (CAST(sum(relief) AS DOUBLE) / count(*)) / (CAST(sum(sum(relief)) OVER () AS DOUBLE) / sum(count(*)) OVER ()) AS lift
  FROM deciled GROUP BY decile)"""


@query("m14_decile_table", SCORED + DECILED + DECILES + " SELECT * FROM deciles")
def decile_table(spark, sf):
    return M.decile_table(scored(spark, sf, ""), "relief", "relief_score", "case_id", case_bucket())


@query("w4_cumulative_capture", SCORED + DECILED + DECILES + " SELECT decile, cumulative_capture, lift FROM deciles")
def cumulative_capture(spark, sf):
    return decile_table(spark, sf).select("decile", "cumulative_capture", "lift")


@query("m15_score_rounding", SCORED + """
SELECT case_id, CAST((score_u * 2 + 100) // 200 AS DOUBLE) / 10000 AS relief_score FROM scored""")
def score_rounding(spark, sf):
    return scored(spark, sf, "").select("case_id", F.round("relief_score", 4).alias("relief_score"))
