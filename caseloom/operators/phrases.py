"""Phrases that go with better or worse outcomes than the product mix predicts."""
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from caseloom import settings as S
from caseloom.functions import text as X
from caseloom.functions.numbers import ratio
from caseloom.operators.skew import broadcast_if_small
from caseloom.operators.standardize import baseline_rate, expected_rate, stratum_totals
from caseloom.plans.lineage import cut

BROADCAST_PHRASES = 1_000_000
TASK_PHRASES = 100_000      # that a task holds before it hands them on


def case_phrases(df: DataFrame, stop=(), text: str = "narrative_clean") -> DataFrame:
    """One row a case with its distinct phrases, written: texts are taken apart once."""
    named, left_out = ["product", "company", "relief", "is_duplicate_text"], frozenset(stop)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            low, own, ends = 0, [], [0]
            for i, clean in enumerate(batch.column("_text"), 1):
                own += dict.fromkeys(X.grams_of(clean.as_py(), left_out))
                ends.append(len(own))
                if i == len(batch) or len(own) >= TASK_PHRASES:
                    part = batch.slice(low, i - low)
                    phrases = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own, pa.string()))
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in named], phrases], [*named, "phrases"])
                    low, own, ends = i, [], [0]

    kept = [StructField(c, df.schema[c].dataType) for c in named]
    texts = df.select(*named, F.col(text).alias("_text"))
    return cut(texts.mapInArrow(run, StructType([*kept, StructField("phrases", ArrayType(StringType()))])))


def phrase_cells(cases: DataFrame, min_docs: int) -> DataFrame:
    """Cases, relief cases and copied cases per (phrase, product, company) of all phrases that `min_docs` cases use or
    more, and of few others: cases are counted by the hash of a phrase first, so most rare phrases never become cells and none is
    exchanged as text to be counted. A phrase counts once per case. Counting combines map-side, so a phrase found everywhere is no hot key."""
    used = cases.select("product", "company", "relief", "is_duplicate_text", F.explode("phrases").alias("phrase")).withColumn(
        "_hash", F.xxhash64("phrase"))
    frequent = cut(used.groupBy("_hash").agg(F.count("*").alias("_cases")).where(F.col("_cases") >= min_docs).select("_hash"))
    return used.join(broadcast_if_small(frequent, BROADCAST_PHRASES), "_hash", "left_semi").groupBy("phrase", "product", "company").agg(
        F.count("*").alias("n"), F.sum("relief").alias("hits"), F.sum("is_duplicate_text").alias("copied"))


def phrase_gaps(df: DataFrame, min_docs: int = 400, stop=(), max_company: float = 0.35,
                max_template: float = 0.30, vague=S.VAGUE_WORDS) -> DataFrame:
    """Rate, expected rate and gap of every phrase used in `min_docs` cases or more.

    Left out: phrases that mostly come from one company or from copied texts, vague words. The
    text is read and taken apart once: one set of cells gives the sums by product and by company."""
    cells = phrase_cells(case_phrases(df, stop), min_docs)
    both = cells.groupingSets([["phrase", "product"], ["phrase", "company"]], "phrase", "product", "company").agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("copied").alias("copied"),
        (F.grouping("company") == 1).alias("by_product"),
    )
    by_product = F.col("by_product")
    totals = stratum_totals(df, "product", "relief")
    based = both.join(totals, F.col("product").eqNullSafe(F.col("_stratum")), "left").withColumn(
        "base", F.when(by_product, baseline_rate("fallback")))
    n = F.sum(F.when(by_product, F.col("n")))
    hits = F.sum(F.when(by_product, F.col("hits")))
    copied = F.sum(F.when(by_product, F.col("copied")))
    return (
        based.groupBy("phrase").agg(
            n.alias("cases"),
            ratio(hits, n).alias("relief_rate"),
            expected_rate(F.when(by_product, F.col("n")), F.col("base")).alias("expected_rate"),
            ratio(F.max(F.when(~by_product, F.col("n"))), n).alias("top_company_share"),
            ratio(copied, n).alias("template_share"),
        )
        .where(F.col("cases") >= min_docs)      # a rare phrase may share its hash with a frequent one
        .where((F.col("top_company_share") <= max_company) & (F.col("template_share") <= max_template))
        .where(~F.col("phrase").isin(list(vague)))
        .withColumn("gap_pts", (F.col("relief_rate") - F.col("expected_rate")) * 100)
    )


def greedy_pick(phrases: DataFrame, n: int = 12, most: bool = True, batch: int = 1000) -> DataFrame:
    """Walk the phrases by gap and keep one when it shares no word stem with an earlier pick,
    until `n` are kept. Ties of the gap go by name.

    Runs jobs: `phrases` should be a written or checkpointed table. The driver sees `batch` rows
    at a time. When they aren't enough, the next batch leaves out every phrase that clashes
    with a pick, so the outcome is that of one walk over all phrases, however many there are."""
    gap = F.desc("gap_pts") if most else F.asc("gap_pts")
    stems = F.array_distinct(F.transform(F.split("phrase", " "), X.stem))
    ranked = phrases.select("phrase", "gap_pts", stems.alias("stems"))
    picks, used = [], set()
    while len(picks) < n:
        free = ranked
        if used:
            free = ranked.where(~F.arrays_overlap("stems", F.array(*[F.lit(s) for s in sorted(used)])))
        head = free.orderBy(gap, "phrase").limit(batch).collect()
        if not head:
            break
        for row in head:
            if len(picks) < n and used.isdisjoint(row["stems"]):
                picks.append(row["phrase"])
                used.update(row["stems"])
    return phrases.where(F.col("phrase").isin(picks))


def phrase_table(phrases: DataFrame, n: int = 12) -> DataFrame:
    """The `n` phrases with the largest gaps in both directions."""
    # The names of the directions.
    up = greedy_pick(phrases, n, most=True).withColumn("direction", F.lit("more relief than expected"))
    down = greedy_pick(phrases, n, most=False).withColumn("direction", F.lit("less relief than expected"))
    return up.unionByName(down)
