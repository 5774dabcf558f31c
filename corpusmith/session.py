"""The few things asked of a session: a shared folder and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach; one of our own only where master is local."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpusmith-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A name nobody has used yet below the shared folder."""
    return f"{shared_folder(spark)}/corpusmith-{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read from there.

    Computed once, safe from the loss of any executor, and of a size Catalyst knows.
    """
    folder = new_folder(df.sparkSession, "step")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Marks a table for broadcast after counting it; a larger one is left to Catalyst.

    Counted where its rows are: of a written table only the footers are read.
    """
    return F.broadcast(df) if df.count() <= rows else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Redistribute a scan that has fewer splits than the cluster has cores.

    Meant for small inputs in front of heavy work per row.  A large table has splits
    enough and is left where it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
