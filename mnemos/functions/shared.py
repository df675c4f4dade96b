"""Writing intermediate results where all executors can read them."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table that goes to every task.
FEW = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of this session's checkpoints, under spark.checkpoint.dir.

    Only a session that runs in one process may do without that setting; then a temporary folder is used.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spilled(df: DataFrame) -> DataFrame:
    """df written as Parquet to a folder of its own in the shared one, and read from there, column by column as needed."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, most: int = FEW) -> DataFrame:
    """df for a join that sends it to every task, if it has at most so many rows; else as it is, and the join shuffles both sides."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
