"""Verbatim copies of a text."""
from pyspark.sql import DataFrame, functions as F

from caseloom.operators.skew import attach_by_key
from caseloom.plans.lineage import cut


def group_sizes(df: DataFrame, group: str = "text_group") -> DataFrame:
    """Rows per text group. Counting combines map-side, so a huge group is one small row per task."""
    return df.groupBy(group).agg(F.count("*").alias("dup_count"))


def mark_copies(df: DataFrame, group: str = "text_group", row_id: str = "case_id") -> DataFrame:
    """Group size and duplicate flag on every row. No window over a group: one form letter may
    make up a third of all cases. Group sizes are written once."""
    sized = attach_by_key(df, cut(group_sizes(df, group)), group, "dup_count", row_id)
    return sized.withColumn("is_duplicate_text", (F.col("dup_count") > 1).cast("int"))


def first_per_group(df: DataFrame, group: str = "text_group", row_id: str = "case_id") -> DataFrame:
    """The row with the smallest id of every group.

    Only (group, id) goes through the aggregation; texts travel once, in the join on the
    unique id."""
    keep = df.groupBy(group).agg(F.min(row_id).alias(row_id)).select(row_id)
    return df.join(keep, row_id, "left_semi")
