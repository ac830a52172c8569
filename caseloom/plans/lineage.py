"""Cutting lineage so that iterative and repeated work survives lost executors."""
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; in local mode without one, a new folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="caseloom-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to a new table in the shared folder and read on from there.

    A Parquet table rather than checkpoint(): later steps still read only the columns they use,
    and the planner knows the size. Compressed with zstd: it is written once and lies there until the end."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
