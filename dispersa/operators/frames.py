"""Small helpers on DataFrames that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship


def materialize(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder that ``spark.checkpoint.dir`` names: it cuts lineage and outlives executors.

    Only a local session without that setting gets a folder of this machine.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="dispersa-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names; only a local session without it gets one of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="dispersa-shared-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ready(df: DataFrame) -> DataFrame:
    """``df``, once executors have this package."""
    ship(df.sparkSession)
    return df


def positions(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` with ``pos``, the place of each row in a total order, from 0.

    Rows are range-partitioned and numbered within partitions; only the count of each partition is summed, so no task
    holds all rows.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m"))
    parts = materialize(parts)
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__m").alias("__first"))
    starts = sizes.select("__p", "__first", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__start"))
    return parts.join(F.broadcast(starts), "__p").withColumn("pos", F.col("__m") - F.col("__first") + F.col("__start")).drop("__p", "__m", "__first", "__start")
