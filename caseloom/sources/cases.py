"""Raw extract -> typed case columns."""
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from caseloom.plans.lineage import cut

RAW_SCHEMA = T.StructType([
    T.StructField("complaint_id", T.LongType()),
    T.StructField("date_received", T.DateType()),
    T.StructField("product", T.StringType()),
    T.StructField("sub_product", T.StringType()),
    T.StructField("issue", T.StringType()),
    T.StructField("sub_issue", T.StringType()),
    T.StructField("consumer_complaint_narrative", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("zip_code", T.StringType()),
    T.StructField("tags", T.StringType()),
    T.StructField("date_sent_to_company", T.DateType()),
    T.StructField("company_response_to_consumer", T.StringType()),
    T.StructField("timely_response", T.StringType()),
])


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Typed columns of a headed CSV, plain or gzip, picked by name from its header.

    One gzip file is read by one task, so ingest once and work on the Parquet copy. Types are
    declared, never inferred: all columns are read as text, then cast."""
    text = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .csv(path)
    )
    return text.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """What `read_raw_csv` gives, from files whose quoted fields hold line breaks, read in parallel splits.

    A split can't tell whether it begins inside quotes. So quotes are counted per split first, and a running sum over the
    splits of a file, a few numbers each, gives every split the parity it begins with. A line begins a record when the quotes
    before it in the file are even; a record that runs into the next split is put together by the place of its first
    line. Needs files in which every quote belongs to a quoted field or is doubled inside one (RFC 4180); a
    compressed file is one split."""
    names = spark.read.option("header", True).option("escape", '"').csv(path).columns
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), "value")
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(lines.groupBy("file", "split").agg(F.sum(quotes).alias("quotes")))
    parity = counts.select("file", "split", F.coalesce(F.sum("quotes").over(before), F.lit(0)).alias("carry"))
    inside = Window.partitionBy("file", "split").orderBy("at")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.join(F.broadcast(parity), ["file", "split"]).withColumn(
        "begins", (F.col("carry") + F.coalesce(F.sum(quotes).over(earlier), F.lit(0))) % 2 == 0)
    numbered = cut(placed.select("file", "split", "at", "value", F.last(F.when(F.col("begins"), F.col("at")), True).over(inside).alias("record")))
    lasts = numbered.groupBy("file", "split").agg(F.max("record").alias("last"))
    open_ = cut(lasts.select("file", "split", F.last("last", True).over(before).alias("open")))
    heads = F.broadcast(numbered.groupBy("file").agg(F.min_by("record", F.struct("split", "at")).alias("head")))
    records = (
        numbered.join(F.broadcast(open_), ["file", "split"]).join(heads, "file")
        .withColumn("record", F.coalesce("record", "open")).where(F.col("record") != F.col("head"))
        .groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("split", "at", "value"))).alias("lines"))
    )
    text = F.regexp_replace(F.array_join(F.col("lines.value"), "\n"), r"\r\z", "")
    fields = ", ".join(f"`{n}` string" for n in names)
    parsed = records.where(text != "").select(F.from_csv(text, fields, {"escape": '"', "multiLine": "true"}).alias("r"))
    return parsed.select(*[F.col(f"r.{f.name}").cast(f.dataType).alias(f.name) for f in schema.fields])


def read_raw_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a source with fewer splits than cores (one large file, one row group) over all cores,
    so that what follows runs in parallel. A source with enough splits is left where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def unmapped_labels(df: DataFrame, label: str, mapping: dict[str, str]) -> DataFrame:
    """Labels without a short name (null included) and how many rows carry them."""
    known = F.coalesce(F.col(label).isin(list(mapping)), F.lit(False))
    return df.where(~known).groupBy(label).agg(F.count("*").alias("cases"))


def map_labels(df: DataFrame, label: str, short: str, mapping: dict[str, str],
               strict: bool = True) -> DataFrame:
    """Add the short name of a label. `strict` fails the job on a label without one.

    The map is a literal inside the projection: no join, and the check costs no extra pass."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), F.col(label))
    if strict:
        complaint = F.concat(F.lit("Unmapped label: "), F.coalesce(F.col(label), F.lit("(null)")))
        found = F.when(found.isNull(), F.raise_error(complaint).cast("string")).otherwise(found)
    return df.withColumn(short, found)


def fill_defaults(raw: DataFrame) -> DataFrame:
    """Raw names -> case names with the null and trim rules of the case model."""
    text = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    return raw.withColumnsRenamed({
        "complaint_id": "case_id",
        "product": "product_full",
        "company_response_to_consumer": "company_response",
    }).withColumns({
        "sub_product": text("sub_product", "(none)"),
        "sub_issue": text("sub_issue", "(none)"),
        "company": F.trim("company"),
        "state": text("state", "Unknown"),
        "zip3": F.substring(text("zip_code", ""), 1, 3),
        "tags": text("tags", ""),
        "timely": F.coalesce(F.col("timely_response") == "Yes", F.lit(False)).cast("int"),
        "narrative": text("consumer_complaint_narrative", ""),
    }).drop("zip_code", "timely_response", "consumer_complaint_narrative")
