"""Registered queries that take a table through a file format and back, and further operators of the library.

Formats are written to a new path in the shared folder and read from there by the reader under test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markup, metrics
from ..operators import coresets, selection, statistics, text
from ..operators.frames import shared_folder
from ..operators.matroids import Partition
from ..sources import files, generators
from .oracles import POINTS, WORDS, matching
from .queries import CAPS, K, points, query, r4, ranked_vectors, small, table

#: Pages of one file of a dump.
DUMP_PAGES = 50_000


def _lines(spark: SparkSession, rows: DataFrame, value) -> str:
    """A new text file of one line a row."""
    path = shared_folder(spark, "lines")
    rows.select(value.alias("value")).write.text(path)
    return path


# --- files ------------------------------------------------------------------------------------------------------


@query("SELECT CAST(vec_id AS BIGINT) AS id, len(embedding) AS dim, round(CAST(embedding[1] AS DOUBLE), 4) + 0.0 AS x, (SELECT count(*) FROM embeddings) AS stored FROM embeddings")
def points_file(spark, sf_dir):
    """Points and their metadata, written and read."""
    path = files.points_path(shared_folder(spark, "points"), "embeddings", 64, 0, 0)
    rows = points(spark, sf_dir).select("id", "vec")
    files.write_points(rows, path, {"data.num-points": rows.count()})
    stored = files.read_metadata(spark, path)["data.num-points"]
    return files.read_points(spark, path, recursive=True).select("id", F.size("vec").cast("long").alias("dim"), r4(F.element_at("vec", 1), "x"), F.lit(stored).cast("long").alias("stored"))


@query("SELECT count(*) AS n, round(sum(CAST(embedding[1] AS DOUBLE)), 4) + 0.0 AS x, round(sum(CAST(embedding[64] AS DOUBLE)), 4) + 0.0 AS y FROM embeddings")
def points_text(spark, sf_dir):
    """One line a point, coordinates joined by commas."""
    path = shared_folder(spark, "points-text")
    files.write_points_text(points(spark, sf_dir), path)
    parts = F.split("value", ",")
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("n"), r4(F.sum(parts[0].cast("double")), "x"), r4(F.sum(F.element_at(parts, 64).cast("double")), "y"))


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_brand FROM part")
def cached_table(spark, sf_dir):
    """A table that is made once and then read from its cache."""
    path = shared_folder(spark, "cached")
    made = files.cached(spark, path, lambda: table(spark, sf_dir, "part").select("p_partkey", "p_brand"))
    return files.cached(spark, path, lambda: made.limit(0))


_TOP = "v AS MATERIALIZED (SELECT word, row_number() OVER (ORDER BY sum(n) DESC, word) AS word_id FROM w GROUP BY word)"


def _numbered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Counts of words, and the words in the order of their counts with numbers from 1."""
    counts = text.word_counts(table(spark, sf_dir, "documents"))
    return counts, text.ranked(counts).select("word", (F.col("rank") + 1).alias("word_id"))


@query(f"WITH {WORDS}, {_TOP} SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS words, CAST(sum(n) AS DOUBLE) AS total, CAST(sum(n * word_id) AS DOUBLE) AS mark FROM w JOIN v USING (word) GROUP BY doc_id")
def musixmatch_file(spark, sf_dir):
    """Bags in lines ``track,other,word:count,...`` under a comment and a vocabulary."""
    counts, words = _numbered(spark, sf_dir)
    cells = counts.join(words, "word").groupBy("doc_id").agg(F.array_join(F.collect_list(F.concat_ws(":", F.col("word_id").cast("string"), F.col("n").cast("string"))), ",").alias("cells"))
    rows = cells.select(F.concat_ws(",", F.col("doc_id").cast("string"), F.lit("0"), "cells").alias("line")).unionByName(spark.sql("SELECT '# comment' AS line UNION ALL SELECT '%a,b' UNION ALL SELECT ''"))
    bags = files.read_musixmatch(spark, _lines(spark, rows, F.col("line")))
    pairs = F.map_entries("bag")
    total = F.aggregate(pairs, F.lit(0.0), lambda s, e: s + e["value"])
    mark = F.aggregate(pairs, F.lit(0.0), lambda s, e: s + e["value"] * e["key"].cast("double"))
    return bags.select("doc_id", F.size("bag").cast("long").alias("words"), total.alias("total"), mark.alias("mark"))


@query(f"WITH {WORDS}, {_TOP} SELECT word_id, word FROM v WHERE word_id <= 1000")
def musixmatch_vocabulary(spark, sf_dir):
    """The thousand most frequent words as the line of ``%``."""
    words = _numbered(spark, sf_dir)[1].filter("word_id <= 1000")
    line = words.agg(F.array_sort(F.collect_list(F.struct("word_id", "word"))).alias("w")).select(F.concat(F.lit("%"), F.array_join(F.transform("w", lambda x: x["word"]), ",")).alias("line"))
    return files.read_musixmatch_vocabulary(spark, _lines(spark, line, F.col("line"))).select(F.col("word_id").cast("long").alias("word_id"), "word")


@query(f"WITH {WORDS}, {_TOP} SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS words, CAST(sum(n) AS DOUBLE) AS total FROM w JOIN v USING (word) GROUP BY doc_id")
def docword_file(spark, sf_dir):
    """Bags in lines ``doc word count`` under a head of three lines."""
    counts, words = _numbered(spark, sf_dir)
    rows = counts.join(words, "word").select(F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("word_id").cast("string"), F.col("n").cast("string")).alias("line")).unionByName(spark.sql("SELECT '1000' AS line UNION ALL SELECT '70000' UNION ALL SELECT '9'"))
    bags = files.read_docword(spark, _lines(spark, rows, F.col("line")))
    return bags.select("doc_id", F.size("bag").cast("long").alias("words"), F.aggregate(F.map_values("bag"), F.lit(0.0), lambda s, x: s + x).alias("total"))


@query(r"WITH d AS (SELECT doc_id, regexp_replace(text, '[\t\n\r]', ' ', 'g') AS t, source FROM documents), w AS (SELECT doc_id, source, unnest(string_split_regex(lower(t), '[^\p{L}\p{N}]+')) AS word FROM d) SELECT CAST(doc_id AS VARCHAR) AS title, 2 AS categories, count(DISTINCT word) AS words, CAST(count(*) AS DOUBLE) AS total FROM w WHERE length(word) > 1 GROUP BY doc_id")
def wiki_tsv_file(spark, sf_dir):
    """Lines ``title<TAB>categories<TAB>rank<TAB>text``."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), F.lit("[first, second]"), F.lit("1"), F.regexp_replace("text", "[\t\n\r]", " "))
    got = files.read_wiki_tsv(spark, _lines(spark, docs, line))
    return got.select("title", F.size("categories").alias("categories"), F.size("bag").cast("long").alias("words"), F.aggregate(F.map_values("bag"), F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS track_id, p_brand AS genre FROM part")
def genres_file(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    return files.read_genres(spark, _lines(spark, rows, F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_brand")))


@query("SELECT p_type AS label, CAST(count(*) AS INT) AS cap FROM part GROUP BY p_type")
def caps_file(spark, sf_dir):
    """Caps of labels whose spaces are underscores in the file."""
    rows = statistics.counted(table(spark, sf_dir, "part"), F.col("p_type"))
    return files.read_caps(spark, _lines(spark, rows, F.concat_ws(" ", F.replace("label", F.lit(" "), F.lit("_")), F.col("n").cast("string"))))


@query(f"WITH {WORDS}, {_TOP}, b AS (SELECT doc_id, count(*) AS words, sum(n) AS total FROM w JOIN v USING (word) WHERE word_id <= 5000 GROUP BY doc_id) SELECT CAST(b.doc_id AS VARCHAR) AS track_id, coalesce(d.lang, 'Unknown') AS genre, words, CAST(total AS DOUBLE) AS total FROM b JOIN documents d ON b.doc_id = d.doc_id")
def song_vectors(spark, sf_dir):
    """Sparse vectors of 5,000 words with a genre."""
    counts, words = _numbered(spark, sf_dir)
    bags = counts.join(F.broadcast(words.filter("word_id <= 5000")), "word").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("word_id").cast("string"), F.col("n").cast("double")))).alias("bag"))
    genres = table(spark, sf_dir, "documents").filter("lang IS NOT NULL").select(F.col("doc_id").cast("string").alias("track_id"), F.col("lang").alias("genre"))
    got = files.songs(bags, genres).select("track_id", "genre", F.unwrap_udt("vec").alias("vec"))
    return got.select("track_id", "genre", F.size(F.filter("vec.values", lambda v: v != 0)).cast("long").alias("words"), F.aggregate("vec.values", F.lit(0.0), lambda s, v: s + v).alias("total"))


@query("SELECT 'word' || CAST(vec_id AS VARCHAR) AS word, len(embedding) AS dim, round(CAST(embedding[64] AS DOUBLE), 4) + 0.0 AS x FROM embeddings")
def embeddings_text_file(spark, sf_dir):
    """Lines ``word f1 ... fd``."""
    path = _lines(spark, points(spark, sf_dir), F.concat_ws(" ", F.concat(F.lit("word"), F.col("id").cast("string")), F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")))
    return files.read_embeddings_text(spark, path).select("word", F.size("vec").cast("long").alias("dim"), r4(F.element_at("vec", 64), "x"))


@query("SELECT CAST(vec_id AS BIGINT) AS id, 'page ' || CAST(vec_id AS VARCHAR) AS title, CAST(label AS BIGINT) AS topic, round(CAST(embedding[2] AS DOUBLE), 4) + 0.0 AS x FROM embeddings WHERE vec_id % 7 <> 0")
def topic_pages_file(spark, sf_dir):
    """JSON lines in bz2 with a vector as text; rows without topics or with a zero vector are dropped."""
    rows = points(spark, sf_dir)
    topic = F.when((F.col("id") % 7 == 0) & (F.col("id") % 2 == 0), F.expr("cast(array() AS array<long>)")).otherwise(F.array(F.col("label").cast("long")))
    vec = F.when(F.col("id") % 7 == 0, F.transform("vec", lambda x: F.lit(0.0))).otherwise(F.col("vec"))
    path = shared_folder(spark, "topic-pages")
    files.write_topic_pages(rows.select("id", F.concat(F.lit("page "), F.col("id").cast("string")).alias("title"), topic.alias("topic"), vec.alias("vec")), path, 100)
    return files.read_topic_pages(spark, path).select("id", "title", F.element_at("topic", 1).alias("topic"), r4(F.element_at("vec", 2), "x"))


def _dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the pages of a dump: markup with a template, links, emphasis and a category; every fifth is a redirect, every seventh a template."""
    k = F.col("p_partkey").cast("string")
    source = F.concat(F.lit("'''"), F.col("p_name"), F.lit("''' is [[Kind|of kind]] "), F.col("p_brand"), F.lit("<ref>none</ref>, {{size|"), F.col("p_size").cast("string"), F.lit("}}.\n[[Category:"), F.col("p_brand"), F.lit("]]"))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(source, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    redirect = F.when(F.col("p_partkey") % 5 == 0, F.lit('<redirect title="Elsewhere" />')).otherwise(F.lit(""))
    ns = F.when(F.col("p_partkey") % 7 == 0, F.lit("10")).otherwise(F.lit("0"))
    page = F.concat(F.lit("<page><title>Part "), k, F.lit("</title><ns>"), ns, F.lit("</ns><id>"), k, F.lit("</id>"), redirect, F.lit("<revision><id>1</id><text>"), body, F.lit("</text></revision></page>"))
    part = table(spark, sf_dir, "part")
    # a dump of several files, each of them whole
    n = max(1, -(-part.count() // DUMP_PAGES))
    pages = part.select(F.pmod(F.xxhash64("p_partkey"), F.lit(n)).alias("file"), F.lit(1).alias("k"), page.alias("line"))
    ends = spark.range(n).select(F.col("id").alias("file"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("<mediawiki>").alias("line")), F.struct(F.lit(2).alias("k"), F.lit("</mediawiki>").alias("line")))).alias("end")).select("file", "end.k", "end.line")
    path = shared_folder(spark, "dump")
    # a folder for each file: a reader may stop at the end of the first of two dumps in one file
    pages.unionByName(ends).repartitionByRange(n, "file").sortWithinPartitions("file", "k").select("file", "line").write.partitionBy("file").text(path)
    return files.read_dump(spark, path)


@query("SELECT CAST(p_partkey AS BIGINT) AS id, CAST(CASE WHEN p_partkey % 7 = 0 THEN 10 ELSE 0 END AS INT) AS ns, 'Part ' || CAST(p_partkey AS VARCHAR) AS title, CASE WHEN p_partkey % 5 = 0 THEN 'Elsewhere' END AS redirect, '''''''' || p_name || ''''''' is [[Kind|of kind]] ' || p_brand || '<ref>none</ref>, {{size|' || CAST(p_size AS VARCHAR) || '}}.' || chr(10) || '[[Category:' || p_brand || ']]' AS text FROM part")
def dump_file(spark, sf_dir):
    """Pages of a MediaWiki export."""
    return _dump(spark, sf_dir).select("id", "ns", "title", "redirect", "text")


@query("SELECT CAST(p_partkey AS BIGINT) AS id, 'https://wiki?curid=' || CAST(p_partkey AS VARCHAR) AS url, 'Part ' || CAST(p_partkey AS VARCHAR) AS title, p_name || ' is of kind ' || p_brand || ', ' || CASE WHEN p_size > 25 THEN 'large' ELSE 'size ' || CAST(p_size AS VARCHAR) END || '.' AS text, false AS cut FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_brand <> (SELECT min(p_brand) FROM part)")
def dump_extract(spark, sf_dir):
    """Articles of the dump as plain text, a template with a condition expanded, and one category left out."""
    left_out = table(spark, sf_dir, "part").agg(F.min("p_brand")).head()[0]
    templates = {"Template:Size": "{{#ifexpr: {{{1}}} > 25 | large | size {{{1}}} }}"}
    return markup.extract(_dump(spark, sf_dir), templates, "https://wiki", exclude={left_out})


@query("SELECT 'Part ' || CAST(p_partkey AS VARCHAR) AS title, p_brand AS categories FROM part")
def page_categories(spark, sf_dir):
    """Titles and categories, joined by commas, of the pages of a dump."""
    return _dump(spark, sf_dir).select("title", F.array_join(markup.dump_categories("text"), ",").alias("categories"))


@query("SELECT doc_id, text, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS pos FROM documents WHERE text IS NOT NULL")
def pages_in_order(spark, sf_dir):
    """Pages written in order to bz2 files of a bounded size; ``pos`` is the place across all files."""
    path = shared_folder(spark, "pages")
    files.write_pages(table(spark, sf_dir, "documents").select("doc_id", "text").filter("text IS NOT NULL"), path, 64 << 10, "doc_id")
    lines = spark.read.schema("doc_id long, text string").json(path).select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("m"))
    firsts = lines.groupBy("file").agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("n"))
    before = firsts.select("file", "first", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return lines.join(before, "file").select("doc_id", "text", (F.col("m") - F.col("first") + F.col("before")).alias("pos"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE chr(CAST(33 + doc_id % 55000 AS INT)) END AS sign FROM documents")
def character_references(spark, sf_dir):
    """Characters of numeric references, none beyond the first plane."""
    code = F.when(F.col("doc_id") % 9 == 0, F.col("doc_id") + 65536).otherwise(F.col("doc_id") % 55000 + 33)
    return table(spark, sf_dir, "documents").select("doc_id", markup.plane_zero(F.concat(F.lit("&#"), code.cast("string"), F.lit(";"))).alias("sign"))


@query("SELECT r_name, 'x' AS tag_a, '2' AS tag_b FROM region")
def report_file(spark, sf_dir):
    """A table of a report as JSON lines, with its tags."""
    path = shared_folder(spark, "report")
    files.write_report({"regions": table(spark, sf_dir, "region").select("r_name")}, {"b": 2, "a": "x"}, path)
    return files.read_any(spark, f"{path}/regions/*.json").select("r_name", "tag_a", "tag_b")


# --- texts and bags ---------------------------------------------------------------------------------------------


@query(f"WITH {WORDS}, v AS (SELECT word, row_number() OVER (ORDER BY total DESC, word) - 1 AS i FROM (SELECT word, sum(n) AS total FROM w GROUP BY word)), e AS (SELECT word, CAST(embedding AS DOUBLE[]) AS vec FROM v JOIN embeddings ON vec_id = i), m AS (SELECT doc_id, count(*) AS s, sum(n * vec[1]) AS x, sum(n * vec[64]) AS y FROM w JOIN e USING (word) GROUP BY doc_id) SELECT doc_id, round(x / s, 4) + 0.0 AS x, round(y / s, 4) + 0.0 AS y FROM m")
def weighted_word_vector(spark, sf_dir):
    """Sums of the vectors of each document's tokens over its number of distinct known words."""
    counts = text.word_counts(table(spark, sf_dir, "documents"))
    got = text.mean_vectors(counts, ranked_vectors(spark, sf_dir, counts), weighted=True)
    return got.select("doc_id", r4(F.element_at("vec", 1), "x"), r4(F.element_at("vec", 64), "y"))


@query(f"WITH {WORDS}, b AS (SELECT doc_id, string_agg(word || ' -> ' || n, ', ' ORDER BY word) AS s FROM w GROUP BY doc_id) SELECT doc_id, '[' || coalesce(s, '') || ']' AS words FROM documents LEFT JOIN b USING (doc_id)")
def bag_texts(spark, sf_dir):
    """The bag of words of each document as a line of text."""
    return text.bags(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.bag_text(F.col("bag")).alias("words"))


@query(f"WITH {WORDS}, o AS (SELECT word FROM w WHERE doc_id = (SELECT min(doc_id) FROM w)), t AS (SELECT doc_id, count(*) AS k, count(o.word) AS shared FROM w LEFT JOIN o USING (word) GROUP BY doc_id) SELECT doc_id, shared, k + (SELECT count(*) FROM o) - shared AS either FROM t")
def bag_sets(spark, sf_dir):
    """Words that each document has in common with the first one, and words of either."""
    rows = text.bags(table(spark, sf_dir, "documents").select("doc_id", "text")).filter(F.size("bag") > 0)
    first = F.broadcast(rows.orderBy("doc_id").limit(1).select(F.col("bag").alias("first")))
    return rows.crossJoin(first).select("doc_id", F.size(metrics.bag_intersection(F.col("bag"), F.col("first"))).cast("long").alias("shared"), F.size(metrics.bag_union(F.col("bag"), F.col("first"))).cast("long").alias("either"))


@query(f"WITH {WORDS}, {_TOP} SELECT doc_id, count(*) AS words, CAST(sum(n) AS DOUBLE) AS total, CAST(min(word_id) - 1 AS INT) AS first FROM w JOIN v USING (word) GROUP BY doc_id")
def count_vectors(spark, sf_dir):
    """Sparse vectors of counts, by the place of a word in the vocabulary."""
    counts, words = _numbered(spark, sf_dir)
    got = text.vectors(counts.withColumnRenamed("n", "weight"), words.select("word", (F.col("word_id") - 1).alias("index")))
    told = got.select("doc_id", F.unwrap_udt("vec").alias("vec"))
    return told.select("doc_id", F.size("vec.indices").cast("long").alias("words"), F.aggregate("vec.values", F.lit(0.0), lambda s, v: s + v).alias("total"), F.get("vec.indices", F.lit(0)).alias("first"))


@query("SELECT DISTINCT unnest(string_split(p_type, ' ')) AS label FROM part")
def label_set(spark, sf_dir):
    return statistics.distinct_labels(table(spark, sf_dir, "part").select(F.split("p_type", " ").alias("labels")), "labels")


@query("SELECT count(*) AS seen FROM lineitem")
def rows_observed(spark, sf_dir):
    """Rows counted as they pass."""
    rows, seen = statistics.observed(table(spark, sf_dir, "lineitem").select("l_orderkey"), "lineitem")
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"],)], "seen long")


@query("SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0")
def useful_rows(spark, sf_dir):
    """Vectors with at least two parts other than 0."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.array("l_discount", "l_tax").alias("vec"))
    return text.useful_vectors(rows, "vec", 2).agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query(f"WITH {POINTS} SELECT CAST(id AS BIGINT) AS id, round(sqrt(list_dot_product(vec, vec)), 4) AS norm, 64 AS parts FROM p")
def point_rows(spark, sf_dir):
    """Points as rows of a report: length and coordinates as text."""
    return files.as_row(points(spark, sf_dir)).select("id", r4(F.col("norm"), "norm"), F.size(F.split("point", " ")).alias("parts"))


@query("SELECT p_partkey AS id, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS title, 'https://wiki?curid=' || CAST(p_partkey AS VARCHAR) AS url FROM part")
def page_titles(spark, sf_dir):
    from pyspark.sql.functions import pandas_udf

    from ..operators.frames import ready

    rows = ready(table(spark, sf_dir, "part"))
    first_upper = pandas_udf(lambda s: s.map(markup.ucfirst), "string")
    return rows.select(F.col("p_partkey").alias("id"), first_upper("p_name").alias("title"), markup.page_url("https://wiki", F.col("p_partkey")).alias("url"))


# --- selections -------------------------------------------------------------------------------------------------

_PAIRS = "d AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_distance(a.vec, b.vec) AS d FROM p a JOIN p b ON a.id < b.id)"


@query(f"WITH {POINTS}, {_PAIRS} SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(d, 4) AS distance FROM d ORDER BY d DESC, a, b LIMIT 50")
def farthest_pairs(spark, sf_dir):
    """The fifty farthest pairs."""
    return selection.top_pairs(points(spark, sf_dir), 50).select("a", "b", r4(F.col("distance"), "distance"))


@query(f"WITH {POINTS}, {_PAIRS}, e AS (SELECT min(d) AS lo, max(d) AS hi FROM d) SELECT CAST(least(19, floor((d - lo) / (hi - lo) * 20)) AS INT) AS bucket, 2 * count(*) AS n FROM d, e GROUP BY 1")
def pair_histogram(spark, sf_dir):
    """Distances of all pairs in both orders."""
    return selection.pair_histogram(points(spark, sf_dir), 20).select("bucket", (2 * F.col("n")).alias("n"))


@query(f"WITH {POINTS}, o AS (SELECT vec FROM p ORDER BY id LIMIT 1) SELECT CAST(id AS BIGINT) AS id, round(0.5 * acos(least(1.0, greatest(-1.0, list_dot_product(p.vec, o.vec) / (sqrt(list_dot_product(p.vec, p.vec)) * sqrt(list_dot_product(o.vec, o.vec)))))), 4) AS distance FROM p, o")
def scaled_cosine(spark, sf_dir):
    """The angle times a factor."""
    rows = points(spark, sf_dir)
    origin = rows.orderBy("id").select("vec").head()
    return rows.select("id", r4(metrics.cosine_scaled(0.5)(F.col("vec"), metrics.literal(origin.vec)), "distance"))


@query(f"WITH {POINTS}, q AS (SELECT list_transform(vec, lambda x: x / 4) AS v, vec, id FROM p) SELECT CAST(id AS BIGINT) AS id, round(list_distance(v, vec), 4) AS distance FROM q")
def scaled_points(spark, sf_dir):
    """Every point beside itself divided by four."""
    rows = points(spark, sf_dir)
    return rows.select("id", r4(metrics.euclidean(metrics.scaled(F.col("vec"), 4), F.col("vec")), "distance"))


@query(f"{matching(8)}, s AS (SELECT x, sum(d) AS t FROM (SELECT a AS x, d FROM f UNION ALL SELECT b, d FROM f) GROUP BY x) SELECT round(sum(d), 4) AS clique, round((SELECT min(t) FROM s), 4) AS star FROM f")
def matching_objectives(spark, sf_dir):
    """Clique and star of the matching's selection."""
    rows = points(spark, sf_dir)
    chosen = rows.join(selection.matched(small(rows), 8), "id", "left_semi").select("id", "vec")
    return selection.objectives(chosen).select(r4(F.col("clique"), "clique"), r4(F.col("star"), "star"))


@query(f"WITH {POINTS}, x AS (SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS rc FROM p) WHERE rc <= 2 ORDER BY id LIMIT {K}) SELECT CAST(id AS BIGINT) AS id FROM p WHERE id NOT IN (SELECT id FROM x)")
def left_over(spark, sf_dir):
    """Rows that the greedy independent set leaves."""
    rows = points(spark, sf_dir)
    return rows.join(coresets.greedy_in_sql(rows, K, Partition(CAPS)).select("id"), "id", "left_anti").select("id")


@query(f"SELECT {K} AS n, {K} AS different, {K} AS known, 2 AS most_of_a_label")
def random_independent_law(spark, sf_dir):
    """A random independent set: its size, different rows, all of the table, at most two of a label."""
    rows = points(spark, sf_dir)
    got, _ = selection.random_independent(rows, K, Partition(CAPS), "label", seed=4)
    of_label = got.groupBy("label").count().agg(F.greatest(F.max("count"), F.lit(2)).cast("int").alias("most_of_a_label"))
    told = got.join(rows.select("id").withColumn("there", F.lit(1)), "id", "left").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("id").cast("int").alias("different"), F.sum("there").cast("int").alias("known"))
    return told.crossJoin(F.broadcast(of_label))


@query("SELECT kind, 2000 AS n, 8 AS certificate, 0 AS outside FROM (VALUES ('uniform-sphere'), ('uniform-cube'), ('chasm-sphere'), ('gaussian-sphere'), ('signed-gaussian-sphere')) AS t(kind)")
def generator_law(spark, sf_dir):
    """Of every kind of synthetic points: rows, rows of the certificate, and rows outside the ball or the cube."""
    out = None
    for kind in generators.KINDS:
        vec = F.col("vec")
        cube = F.exists("vec", lambda x: (x < 0) | (x >= 1))
        outside = cube if kind == "uniform-cube" else metrics.norm(vec) > (F.when(F.col("certificate"), 1.0).otherwise(0.8) if kind == "chasm-sphere" else F.lit(1.0)) + 1e-9
        part = generators.generate(spark, kind, 2000, 4, 8, seed=5).agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum(F.col("certificate").cast("int")).cast("int").alias("certificate"), F.sum(outside.cast("int")).cast("int").alias("outside")).select(F.lit(kind).alias("kind"), "n", "certificate", "outside")
        out = part if out is None else out.unionByName(part)
    return out
