"""Counts, histograms and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(values: DataFrame, column: str, buckets: int = 100) -> DataFrame:
    """``(bucket, left, n)``: equal widths from the least value to the largest, which the last bucket includes.

    Nulls and NaN do not count; when all values are equal there is one bucket.
    """
    good = values.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(F.col(column).cast("double").alias("v"))
    ends = good.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(buckets - 1), F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * buckets))).otherwise(0).cast("int")
    return good.crossJoin(F.broadcast(ends)).groupBy(at.alias("bucket"), (F.col("lo") + (F.col("hi") - F.col("lo")) / buckets * at).alias("left")).agg(F.count(F.lit(1)).alias("n"))


def counted(rows: DataFrame, label: Column) -> DataFrame:
    """``(label, n)`` of every label; arrays are ``explode``d by the caller."""
    return rows.select(label.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def distinct_labels(rows: DataFrame, labels: str) -> DataFrame:
    return rows.select(F.explode(labels).alias("label")).distinct()


def admitted(rows: DataFrame, labels: str, wanted: list) -> DataFrame:
    """Rows with at least one wanted label, and only those labels kept."""
    kept = rows.withColumn(labels, F.array_intersect(labels, F.array(*[F.lit(w) for w in wanted])))
    return kept.filter(F.size(labels) > 0)


def admitted_by_cap(rows: DataFrame, label: str, caps: DataFrame) -> DataFrame:
    """Rows whose label has a cap above 0 in ``caps(label, cap)``: a semi join, whose side Spark picks."""
    return rows.join(caps.filter("cap > 0").select(F.col("label").alias(label)), label, "left_semi")


def bigger(rows: DataFrame, words: int, bag: str = "bag") -> DataFrame:
    """Rows with more distinct words than that."""
    return rows.filter(F.size(F.map_keys(bag)) > words)


def containing(rows: DataFrame, words: list, bag: str = "bag") -> DataFrame:
    """Rows with any of the words."""
    return rows.filter(F.arrays_overlap(F.map_keys(bag), F.array(*[F.lit(w) for w in words])))


def transformed(rows: DataFrame, steps: str, bag: str = "bag") -> DataFrame:
    """Applies a comma-separated list of ``bigger(n)`` and ``containing(w;w;...)`` from left to right."""
    import re

    for step in filter(None, (s.strip() for s in steps.split(","))):
        m = re.fullmatch(r"(bigger|containing)\((.*)\)", step)
        if not m:
            raise ValueError(f"no transformation {step}")
        if m[1] == "bigger":
            rows = bigger(rows, int(m[2]), bag)
        else:
            rows = containing(rows, [w.strip() for w in m[2].split(";")], bag)
    return rows


def observed(rows: DataFrame, name: str):
    """``rows`` that count themselves as they pass, and the observation."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen
