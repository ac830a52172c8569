"""A corpus from raw documents to packed sequences: five stages, each written before the next begins."""
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.llm import decontaminate, line_dedup, near_dedup, packing, quality_knn
from caseloom.llm.tables import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours vote them good. Rows are judged by id and text, so null ids and
    repeated ids get the verdict of their own text."""
    model = quality_knn.fit(docs, table(spark, sf_dir, "labels"), "quality")
    scored = quality_knn.scores(docs.withColumn("doc_id", F.xxhash64("doc_id", "text")), model)
    bad = scored.where(F.col("score") < quality_knn.REJECT_BELOW).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.xxhash64("doc_id", "text") == F.col("_bad"), "left_anti")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of each line that has a word, however short, near copies included. A document that loses every line with a word goes."""
    cut = line_dedup.dedup_lines(docs, line_dedup.EVERY_LINE)
    left = (F.size("dropped") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]")
    return cut.where(left).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 80 % or more. At 80 % two sets
    share none of 16 regions with a chance of 1e-5, and differ in over 25 of 96 bits with one of 1.8e-6."""
    return near_dedup.keep_one(docs, near_dedup.Settings(percent=80, apart=25))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, without their ids."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("leaks", leaks), ("pack", pack)]
# Neither the votes nor the tokenizer can be written in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
