"""Registered streaming queries: bounded runs over the driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import ready, shared_folder
from ..operators.matroids import Partition
from ..functions.metrics import euclidean
from ..sources import generators
from . import doubling


def run_once(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs a stream until its source is exhausted, into Parquet in the shared folder; reads what it wrote."""
    spark = stream.sparkSession
    base = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}" if folder else shared_folder(spark, "stream")
    schema = stream.schema
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/embeddings.parquet*")
    return ready(stream).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("label"))


def stream_coreset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The doubling coreset of all vectors, taken as a stream of files."""
    return doubling.latest(run_once(doubling.stream_coreset(_vectors(spark, sf_dir), 16, 3, shards=4))).select("shard", "role", "center_id", "id", "threshold")


def stream_matroid_coreset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under a constraint: two rows of each label at most, for selections of six."""
    caps = {str(c): 2 for c in range(10)}
    got = doubling.stream_coreset(_vectors(spark, sf_dir), 16, shards=4, matroid=Partition(caps), k=6, label="label")
    return doubling.latest(run_once(got)).select("shard", "role", "center_id", "id", "threshold")


def stream_coreset_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each shard's coreset, whether it has tau centres at most, all farther apart than the threshold, and whether every
    row of the shard lies within twice the threshold of one."""
    kept = doubling.latest(run_once(doubling.stream_coreset(_vectors(spark, sf_dir), 16, 3, shards=4)))
    kernel = kept.filter("role = 'kernel'").select("shard", "id", "vec", "threshold")
    other = kernel.select("shard", F.col("id").alias("b"), F.col("vec").alias("w"))
    apart = kernel.join(other, "shard").filter("id <> b").groupBy("shard").agg(F.min(euclidean(F.col("vec"), F.col("w"))).alias("apart"))
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("b"), F.col("embedding").cast("array<double>").alias("w"))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("b"), F.lit(4)))
    near = dealt.join(F.broadcast(kernel), "shard").groupBy("shard", "b").agg(F.min(euclidean(F.col("vec"), F.col("w"))).alias("d")).groupBy("shard").agg(F.max("d").alias("widest"), F.count(F.lit(1)).alias("rows"))
    sizes = kernel.groupBy("shard").agg(F.count(F.lit(1)).alias("centres"), F.max("threshold").alias("threshold"))
    told = sizes.join(apart, "shard", "left").join(near, "shard")
    return told.agg(F.sum("rows").alias("rows"), F.max("centres").alias("most_centres"), F.min(F.coalesce(F.col("apart") > F.col("threshold"), F.lit(True)).cast("int")).alias("apart"), F.min((F.col("widest") <= 2 * F.col("threshold")).cast("int")).alias("covered")).selectExpr("rows", "cast(most_centres <= 16 AS int) AS few", "apart", "covered")


def generated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic points with a hidden certificate."""
    return generators.generate(spark, "uniform-sphere", 1000, 4, 8, seed=3).select("id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"), "certificate")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (stream_coreset, stream_matroid_coreset, stream_coreset_invariants, generated_points)}

ORACLE_SQL: dict[str, str] = {"stream_coreset_invariants": "SELECT count(*) AS rows, 1 AS few, 1 AS apart, 1 AS covered FROM embeddings"}
