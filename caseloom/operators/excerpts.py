"""Short, strongly on-theme narratives to show for every theme."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom import settings as S
from caseloom.functions import text as X
from caseloom.operators.skew import broadcast_if_small
from caseloom.plans.lineage import cut

BROADCAST_CASES = 1_000_000


def strongest(df: DataFrame, pool: int = 300, words: tuple[int, int] = (40, 90)) -> DataFrame:
    """(theme, place, case_id, theme_strength) of the `pool` strongest unique narratives of fitting length per theme.

    No text takes part. Spark keeps only the first `pool` rows per theme and task before the exchange, so a theme
    with a third of all cases is as cheap as any other."""
    place = Window.partitionBy("theme").orderBy(F.desc("theme_strength"), F.asc("case_id"))
    return (
        df.where((F.col("dup_count") == 1) & F.col("narrative_words").between(*words)
                 & (F.col("theme") != S.UNCLASSIFIED))
        .select("theme", "case_id", "theme_strength", F.row_number().over(place).alias("place"))
        .where(F.col("place") <= pool).select("theme", "place", "case_id", "theme_strength")
    )


def alike(a: Column, b: Column) -> Column:
    """Word sets that share more than half of their union."""
    return F.size(F.array_intersect(a, b)) * 2 > F.size(F.array_union(a, b))


def pick_excerpts(df: DataFrame, per_theme: int = 2, pool: int = 300, max_len: int = 520, texts: DataFrame | None = None) -> DataFrame:
    """Walk each theme from the strongest narrative down and keep `per_theme` short ones that
    aren't near-copies of one already kept. A theme brings `pool` rows at most to the walk; texts are read for
    those cases alone, from `texts` (case_id, narrative, product, company_response), or `df` if not given."""
    chosen = cut(strongest(df, pool).drop("theme_strength"))
    told = (df if texts is None else texts).select("case_id", "narrative", "product", "company_response").join(broadcast_if_small(chosen, BROADCAST_CASES), "case_id")
    shown = told.withColumn("text", X.display_text(F.col("narrative"))).where(F.length("text") <= max_len)
    entry = F.struct(
        "place", "case_id", "product", F.col("company_response").alias("outcome"), "text",
        F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("words"),
    )
    lists = shown.groupBy("theme").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    none = F.slice(F.col("entries"), 1, 0)
    keep = lambda kept, e: F.when(
        (F.size(kept) < per_theme) & ~F.exists(kept, lambda k: alike(k["words"], e["words"])),
        F.array_append(kept, e),
    ).otherwise(kept)
    return lists.select("theme", F.inline(F.aggregate("entries", none, keep))).drop("words", "place")
