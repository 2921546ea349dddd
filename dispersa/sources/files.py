"""Readers and writers of the supported files, each to and from DataFrames with a fixed schema."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that one task of ``write_pages`` writes about; their names are in order up to 999 of them.
FILES_A_TASK = 256


def points_path(folder: str, source: str, dim: int, n: int, k: int) -> str:
    return f"{folder.rstrip('/')}/{source}-{dim}-{n}-{k}.points"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def write_metadata(spark: SparkSession, path: str, values: dict) -> None:
    """A one-row JSON table beside the data, at ``path`` with ``.metadata`` behind it."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.metadata")


def read_metadata(spark: SparkSession, path: str) -> dict:
    """What ``write_metadata`` wrote; empty where there is none."""
    if not exists(spark, f"{path}.metadata"):
        return {}
    return json.loads(spark.read.text(f"{path}.metadata").head().value)


def write_points(points: DataFrame, path: str, metadata: dict | None = None) -> None:
    """``(id, vec)`` as Parquet; fails if there is something at ``path``."""
    points.write.mode("errorifexists").parquet(path)
    write_metadata(points.sparkSession, path, metadata or {})


def read_points(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    return spark.read.option("recursiveFileLookup", str(recursive).lower()).parquet(path)


def write_points_text(points: DataFrame, path: str) -> None:
    """One line a point, coordinates joined by commas."""
    points.select(F.array_join(F.transform("vec", lambda x: x.cast("string")), ",")).write.mode("errorifexists").text(path)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path`` with ``.cache`` behind it; made and written the first time."""
    if not exists(spark, f"{path}.cache"):
        make().write.mode("errorifexists").parquet(f"{path}.cache")
    return spark.read.parquet(f"{path}.cache")


def _bag(pairs: Column, key, value) -> Column:
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(key(p), value(p))))


def read_musixmatch(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, bag)`` of lines ``track,other,word:count,...``; lines of ``#`` and ``%`` are skipped; word ids are strings from 1."""
    parts = F.split("value", ",")
    pairs = F.transform(F.filter(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), lambda p: p.contains(":")), lambda p: F.split(p, ":"))
    lines = spark.read.text(path).filter(~F.col("value").rlike("^[#%]") & (F.trim("value") != ""))
    return lines.select(F.element_at(parts, 1).alias("doc_id"), _bag(pairs, lambda p: p[0], lambda p: p[1].cast("double")).alias("bag"))


def read_musixmatch_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(word_id, word)`` of the line of ``%``, from 1."""
    line = spark.read.text(path).filter(F.col("value").startswith("%")).limit(1)
    return line.select(F.posexplode(F.split(F.expr("substring(value, 2)"), ","))).select((F.col("pos") + 1).alias("word_id"), F.col("col").alias("word"))


def read_docword(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, bag)`` of lines ``doc word count``; lines of other lengths, such as the three of the head, are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.size(parts) == 3).select(parts[0].alias("doc_id"), parts[1].alias("word"), parts[2].cast("double").alias("n"))
    return rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("bag"))


def read_docword_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(word_id, word)``: the line of each word, from 1. One file is split by lines only when read whole, so it is."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\n"))).select((F.col("pos") + 1).alias("word_id"), F.col("col").alias("word"))


def docword_paths(folder: str, name: str) -> tuple[str, str]:
    return f"{folder}/docword.{name}.txt", f"{folder}/vocab.{name}.txt"


def read_wiki_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``(title, categories, bag)`` of lines ``title<TAB>categories<TAB>[rank<TAB>]text``.

    Three fields with a number last have no text and are dropped, and so are texts without words of two letters or more.
    """
    from ..operators.text import cells, computed_once

    parts = F.split("value", "\t")
    text = F.when(F.size(parts) == 4, F.element_at(parts, 4)).when((F.size(parts) == 3) & ~F.element_at(parts, 3).rlike(r"^\d+(\.\d+)?$"), F.element_at(parts, 3))
    names = lambda c: F.filter(F.transform(F.split(F.regexp_replace(c, r"[\[\]()]", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = spark.read.text(path).select(F.element_at(parts, 1).alias("title"), names(F.element_at(parts, 2)).alias("categories"), text.alias("text")).filter("text IS NOT NULL")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)
    bag = F.map_from_entries(F.transform(cells(words), lambda c: F.struct(c["word"], c["n"].cast("double"))))
    return computed_once(rows, bag, "bag").filter(F.size("bag") > 0).select("title", "categories", "bag")


def read_genres(spark: SparkSession, path: str) -> DataFrame:
    """``(track_id, genre)`` of lines ``track<TAB>genre``."""
    parts = F.split("value", "\t")
    return spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(parts) >= 2)).select(parts[0].alias("track_id"), parts[1].alias("genre"))


def read_caps(spark: SparkSession, path: str) -> DataFrame:
    """``(label, cap)`` of lines ``genre_with_underscores count``."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(parts) == 2).select(F.replace(parts[0], F.lit("_"), F.lit(" ")).alias("label"), parts[1].cast("int").alias("cap"))


def songs(bags: DataFrame, genres: DataFrame, size: int = 5000) -> DataFrame:
    """``(track_id, genre, vec)``: sparse vectors of bags by word id minus 1; a track without a genre is ``Unknown``.

    Words beyond ``size`` are left out.
    """
    from ..operators.text import sparse

    cells = F.filter(F.transform(F.map_entries("bag"), lambda e: F.struct((e["key"].cast("int") - 1).alias("index"), e["value"].cast("double").alias("weight"))), lambda c: (c["index"] >= 0) & (c["index"] < size))
    joined = bags.withColumnRenamed("doc_id", "track_id").join(genres, "track_id", "left")
    return joined.select("track_id", F.coalesce("genre", F.lit("Unknown")).alias("genre"), sparse(size, cells).alias("vec"))


def read_embeddings_text(spark: SparkSession, path: str) -> DataFrame:
    """``(word, vec)`` of lines ``word f1 ... fd``."""
    parts = F.split("value", " ")
    return spark.read.text(path).filter(F.size(parts) > 1).select(parts[0].alias("word"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.cast("double")).alias("vec"))


def read_topic_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(id, title, topic, vec)`` of JSON lines (bz2 too) whose vector is a string of numbers; rows without topics, or whose vector is zero, are dropped."""
    rows = spark.read.schema("id long, title string, topic array<long>, vector string").json(path)
    vec = F.transform(F.split(F.trim("vector"), r"\s+"), lambda x: x.cast("double"))
    return rows.select("id", "title", "topic", vec.alias("vec")).filter((F.size("topic") > 0) & F.exists("vec", lambda x: x != 0))


def write_topic_pages(pages: DataFrame, path: str, records: int = 100_000) -> None:
    """The inverse of ``read_topic_pages``, in bz2 files of at most so many rows."""
    out = pages.select("id", "title", "topic", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ").alias("vector"))
    out.write.mode("errorifexists").option("maxRecordsPerFile", records).option("compression", "bzip2").json(path)


def write_pages(pages: DataFrame, path: str, most_bytes: int = 1 << 20, by: str = "id") -> None:
    """Pages as JSON lines in bz2 files of about ``most_bytes`` of text each, in page order within and across the files."""
    size, n = pages.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).head()
    count = max(1, -(-size // most_bytes))
    tasks = max(-(-count // FILES_A_TASK), min(count, pages.sparkSession.sparkContext.defaultParallelism))
    out = pages.repartitionByRange(tasks, by).sortWithinPartitions(by)
    out.write.mode("errorifexists").option("maxRecordsPerFile", max(1, n * most_bytes // max(1, size))).option("compression", "bzip2").json(path)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """JSON where the path says so, else Parquet."""
    return spark.read.json(path) if ".json" in path else spark.read.parquet(path)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """``(id, ns, revid, title, redirect, text)`` of a MediaWiki XML export (compressed too), by the built-in XML source."""
    schema = "id long, ns int, title string, redirect struct<_title:string>, revision struct<id:long,text:struct<_VALUE:string>>"
    raw = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return raw.select("id", "ns", F.col("revision.id").alias("revid"), "title", F.col("redirect._title").alias("redirect"), F.col("revision.text._VALUE").alias("text"))


def write_report(tables: dict[str, DataFrame], tags: dict, folder: str) -> None:
    """The tables of an experiment as JSON lines, each row with the tags."""
    marks = [F.lit(str(v)).alias(f"tag_{k}") for k, v in sorted(tags.items())]
    for name, table in tables.items():
        table.select("*", *marks).write.mode("errorifexists").json(f"{folder.rstrip('/')}/{name}")


def as_row(points: DataFrame) -> DataFrame:
    """``(id, norm, point)``: the length of each vector and its coordinates as text."""
    from ..functions.metrics import norm

    return points.select("id", norm(F.col("vec")).alias("norm"), F.array_join(F.transform("vec", lambda x: x.cast("string")), " ").alias("point"))
