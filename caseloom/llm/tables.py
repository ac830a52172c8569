"""Reading the given tables, scratch tables, and joins whose broadcast side is counted first."""
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caseloom.plans.lineage import cut

# Largest side, in rows, that is sent to every executor. Rows here are an id and a few numbers.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the shared folder: a lost executor costs no recomputation."""
    return cut(df)


def narrow(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side of a few narrow columns that has `limit` rows at most; beyond it the
    join shuffles. The count stops at limit + 1 rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once per row, for expressions that index into an array."""
    return F.transform(F.array(value), body)[0]


def in_fit(doc_id: str = "doc_id") -> Column:
    """Rows that models may learn from: crc32 of the id as text, modulo 5, is not 0."""
    return ~held_out(doc_id)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def label_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, label) of `limit` labelled rows at most, none of them held out.

    The sample is the rows with the smallest hash of their id, so it depends on neither order nor
    partitions; ids with two different labels are left out. Its ids are broadcast (at most `limit`)."""
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & in_fit())
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_other"))
        .where(F.col("label") == F.col("_other"))
        .orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(limit).select("doc_id", "label")
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
