"""Registered queries over the driver tables, each over all rows, with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.markup import clean_html, unescape
from ..functions.stemmer import stems
from ..operators import coresets, partitioning, selection, statistics, text
from ..operators.frames import positions, ready
from ..operators.matroids import Partition, Transversal, Uniform
from . import flows
from .oracles import DISTANCE, POINTS, WORDS, matching, parted, porter, traversal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

K, TAU, PARTS = 6, 16, 4
CAPS = {str(c): 2 for c in range(10)}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("label"))


def pid(rows: DataFrame):
    """The part of a row: PARTS of them, or more for parts of at most ROWS_PER_PART rows."""
    return F.pmod("id", F.lit(max(PARTS, -(-rows.count() // coresets.ROWS_PER_PART))))


def small(rows: DataFrame) -> DataFrame:
    """A coreset that one task can take."""
    return coresets.shrink(coresets.coreset(rows, TAU, 1, pid=pid(rows)).select("id", "vec"), TAU)


def r4(c, name: str):
    return (F.round(c, 4) + F.lit(0.0)).alias(name)  # no negative zero


# --- selections -------------------------------------------------------------------------------------------------


@query(f"WITH {traversal(K)} SELECT CAST(step AS INT) AS step, CAST(id AS BIGINT) AS id, round(radius, 4) AS radius FROM c")
def gmm_centers(spark, sf_dir):
    """Farthest-point traversal of all vectors."""
    return selection.farthest_points(points(spark, sf_dir), K).select("step", "id", r4(F.col("radius"), "radius"))


@query(f"WITH {traversal(K)} SELECT CAST(step AS INT) AS step, round(radius, 4) AS radius FROM c WHERE step > 0")
def gmm_radius_trace(spark, sf_dir):
    return selection.farthest_points(points(spark, sf_dir), K).filter("step > 0").select("step", r4(F.col("radius"), "radius"))


@query(f"WITH {traversal(24)} SELECT CAST(id AS BIGINT) AS id FROM c WHERE step = 0 OR radius > 1.5")
def gmm_to_radius(spark, sf_dir):
    return selection.farthest_to_radius(points(spark, sf_dir), 1.5).select("id")


_PAIRS = "d AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_distance(a.vec, b.vec) AS d FROM c a JOIN c b ON a.id < b.id)"


@query(f"WITH {traversal(K)}, {_PAIRS}, s AS (SELECT min(t) AS star FROM (SELECT x, sum(d) AS t FROM (SELECT a AS x, d FROM d UNION ALL SELECT b, d FROM d) GROUP BY x)) SELECT round(min(d), 4) AS edge, round(sum(d), 4) AS clique, round(min(star), 4) AS star, round(avg(d), 4) AS mean_pair FROM d, s")
def objectives(spark, sf_dir):
    """Remote-edge, clique, star and the normalized clique of the traversal's selection."""
    chosen = selection.farthest_points(points(spark, sf_dir), K)
    return selection.objectives(chosen).select(*[r4(F.col(c), c) for c in ("edge", "clique", "star", "mean_pair")])


def _tree_sql() -> str:
    steps = ["t0 AS MATERIALIZED (SELECT id, 0.0 AS w FROM c WHERE step = 0)"]
    for i in range(1, K):
        steps.append(f"t{i} AS MATERIALIZED (SELECT * FROM t{i - 1} UNION ALL (SELECT o.id, e.d AS w FROM (SELECT a AS x, b AS y, d FROM d UNION ALL SELECT b, a, d FROM d) e JOIN t{i - 1} t ON e.x = t.id JOIN c o ON o.id = e.y WHERE o.id NOT IN (SELECT id FROM t{i - 1}) ORDER BY e.d, o.id LIMIT 1))")
    return f"WITH {traversal(K)}, {_PAIRS}, {', '.join(steps)} SELECT round(sum(w), 4) AS tree FROM t{K - 1}"


@query(_tree_sql())
def tree_diversity(spark, sf_dir):
    return selection.tree_weight(selection.farthest_points(points(spark, sf_dir), K).select("id", "vec")).select(r4(F.col("tree"), "tree"))


@query(f"WITH {POINTS}, o AS (SELECT vec FROM p ORDER BY id LIMIT 1) SELECT CAST(p.id AS BIGINT) AS id, " + ", ".join(f"round({d.format(a='p.vec', b='o.vec')}, 4) AS {n}" for n, d in DISTANCE.items()) + " FROM p, o")
def dense_distances(spark, sf_dir):
    """Every metric from each vector to the first one."""
    rows = points(spark, sf_dir)
    origin = rows.orderBy("id").select("vec").head()
    return rows.select("id", *[r4(f(F.col("vec"), metrics.literal(origin.vec)), n) for n, f in metrics.METRICS.items()])


@query(f"WITH {POINTS}, o AS (SELECT vec FROM p ORDER BY id LIMIT 1) SELECT round(sum(list_distance(p.vec, o.vec)), 4) AS total FROM p, o")
def sum_distances(spark, sf_dir):
    rows = points(spark, sf_dir)
    return selection.contribution(rows, rows.agg(F.min("id")).head()[0]).select(r4(F.col("total"), "total"))


@query(f"WITH {traversal(K)} SELECT CAST(p.id AS BIGINT) AS id, CAST(arg_min(c.id, list_distance(p.vec, c.vec)) AS BIGINT) AS center_id, round(min(list_distance(p.vec, c.vec)), 4) AS distance FROM p, c GROUP BY p.id")
def nearest_center(spark, sf_dir):
    rows = points(spark, sf_dir)
    got = selection.nearest_centre(rows.select("id", "vec"), selection.farthest_points(rows, K))
    return got.select("id", "center_id", r4(F.col("distance"), "distance"))


@query(f"WITH {traversal(K)}, n AS (SELECT p.id, arg_min(c.id, list_distance(p.vec, c.vec)) AS center_id, min(list_distance(p.vec, c.vec)) AS d FROM p, c GROUP BY p.id) SELECT CAST(center_id AS BIGINT) AS center_id, count(*) AS size, round(max(d), 4) AS radius FROM n GROUP BY center_id")
def cluster_sizes_radius(spark, sf_dir):
    rows = points(spark, sf_dir)
    got = selection.nearest_centre(rows.select("id", "vec"), selection.farthest_points(rows, K))
    return selection.radius(got).select("center_id", "size", r4(F.col("radius"), "radius"))


@query(f"{matching(8, PARTS, TAU, coresets.ROWS_PER_PART)} SELECT CAST(2 * step AS INT) AS rank, CAST(a AS BIGINT) AS id FROM t3 UNION ALL SELECT CAST(2 * step + 1 AS INT), CAST(b AS BIGINT) FROM t3")
def matching_pairs(spark, sf_dir):
    """Greedy matching of a coreset."""
    rows = points(spark, sf_dir)
    return selection.matched(small(rows), 8)


@query()
def local_search_clique(spark, sf_dir):
    rows = points(spark, sf_dir)
    return selection.local_search(small(rows), 8).select("id", r4(F.col("value"), "value"))


@query()
def approximations(spark, sf_dir):
    """The best selection found for each objective, from several starts."""
    rows = points(spark, sf_dir)
    return selection.approximate(small(rows), 8, runs=8).select("objective", r4(F.col("value"), "value"), "ids")


@query()
def random_independent(spark, sf_dir):
    rows, tries = selection.random_independent(points(spark, sf_dir), K, Partition(CAPS), "label", seed=1)
    return rows.select("id", "label", F.lit(tries).alias("tries"))


@query()
def sampled_diversity(spark, sf_dir):
    return selection.sampled_diversity(points(spark, sf_dir), K, 5, "euclidean", Partition(CAPS), "label")


@query(f"WITH {POINTS}, d AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_distance(a.vec, b.vec) AS d FROM p a JOIN p b ON a.id < b.id) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(d, 4) AS distance FROM d ORDER BY d DESC, a, b LIMIT 1")
def diameter_pair(spark, sf_dir):
    """The farthest pair of all vectors, by numpy blocks of which each gives one."""
    return selection.top_pairs(points(spark, sf_dir), 1).select("a", "b", r4(F.col("distance"), "distance"))


_BOUND = f"""WITH {parted(PARTS, TAU, coresets.ROWS_PER_PART)},
o AS (SELECT *, row_number() OVER (PARTITION BY pid, center_id, label ORDER BY id) AS rc FROM n),
core AS MATERIALIZED (SELECT DISTINCT id FROM (SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY pid, center_id ORDER BY id) AS r FROM o WHERE rc <= 1) WHERE r <= 2 UNION ALL SELECT id FROM c)),
x AS MATERIALIZED (SELECT p.* FROM p JOIN core USING (id)),
e AS MATERIALIZED (SELECT s.id AS a, t.id AS b, s.label AS la, t.label AS lb, list_distance(s.vec, t.vec) AS d FROM x s JOIN x t ON s.id < t.id),
far AS MATERIALIZED (SELECT * FROM e ORDER BY d DESC, a, b LIMIT 1),
alt AS (SELECT e.* FROM e, far WHERE e.la <> e.lb AND (e.a IN (far.a, far.b) OR e.b IN (far.a, far.b)) ORDER BY e.d DESC, e.a, e.b LIMIT 1)"""


@query(f"{_BOUND} SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(d, 4) AS distance FROM (SELECT * FROM far WHERE la <> lb UNION ALL SELECT * FROM alt WHERE (SELECT la = lb FROM far))")
def diameter_bound(spark, sf_dir):
    """The farthest pair of a coreset that may be chosen together when no two rows may share a label."""
    rows = points(spark, sf_dir)
    caps = {c: 1 for c in CAPS}
    core = coresets.matroid_coreset(rows, 2, Partition(caps), "label", tau=TAU, pid=pid(rows))
    return selection.diameter(core.select("id", "vec", "label"), "euclidean", Partition(caps), "label").select("a", "b", r4(F.col("distance"), "distance"))


# --- coresets ---------------------------------------------------------------------------------------------------

_CORE = f"""WITH {parted(PARTS, TAU, coresets.ROWS_PER_PART)},
kernel AS (SELECT pid, 'kernel' AS role, id AS center_id, id FROM c),
delegate AS (SELECT pid, 'delegate' AS role, center_id, id FROM (SELECT *, row_number() OVER (PARTITION BY pid, center_id ORDER BY id) AS r FROM n WHERE d > 0) WHERE r <= 2)"""


@query(f"{_CORE} SELECT CAST(pid AS BIGINT) AS pid, role, CAST(center_id AS BIGINT) AS center_id, CAST(id AS BIGINT) AS id, round(radius, 4) AS radius FROM (SELECT * FROM kernel UNION ALL SELECT * FROM delegate) JOIN (SELECT pid, max(d) AS radius FROM n GROUP BY pid) USING (pid)")
def coreset_mapreduce(spark, sf_dir):
    rows = points(spark, sf_dir)
    got = coresets.coreset(rows, TAU, 3, pid=pid(rows))
    return got.select("pid", "role", "center_id", "id", r4(F.col("radius"), "radius"))


@query(f"{_CORE} SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(id) AS BIGINT) AS ids, round((SELECT max(d) FROM n), 4) AS radius FROM (SELECT DISTINCT id FROM (SELECT id FROM kernel UNION ALL SELECT id FROM delegate))")
def compose_distinct(spark, sf_dir):
    rows = points(spark, sf_dir)
    core = coresets.coreset(rows, TAU, 3, pid=pid(rows))
    return coresets.merge(core, core).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.round(F.max("radius"), 4).alias("radius"))


@query(f"WITH {parted(PARTS, TAU, coresets.ROWS_PER_PART)}, o AS (SELECT *, row_number() OVER (PARTITION BY pid, center_id, label ORDER BY id) AS rc FROM n) SELECT CAST(pid AS BIGINT) AS pid, CAST(center_id AS BIGINT) AS center_id, CAST(id AS BIGINT) AS id FROM (SELECT *, row_number() OVER (PARTITION BY pid, center_id ORDER BY id) AS r FROM o WHERE rc <= 2) WHERE r <= {K} UNION SELECT CAST(pid AS BIGINT), CAST(id AS BIGINT), CAST(id AS BIGINT) FROM c")
def coreset_partition(spark, sf_dir):
    rows = points(spark, sf_dir)
    got = coresets.matroid_coreset(rows, K, Partition(CAPS), "label", tau=TAU, pid=pid(rows))
    return got.select("pid", "center_id", "id")


@query(f"WITH {parted(PARTS, TAU, coresets.ROWS_PER_PART)} SELECT CAST(pid AS BIGINT) AS pid, CAST(center_id AS BIGINT) AS center_id, CAST(id AS BIGINT) AS id FROM (SELECT *, row_number() OVER (PARTITION BY pid, center_id ORDER BY id) AS r FROM n) WHERE r <= 4 UNION SELECT CAST(pid AS BIGINT), CAST(id AS BIGINT), CAST(id AS BIGINT) FROM c")
def coreset_uniform(spark, sf_dir):
    rows = points(spark, sf_dir)
    return coresets.matroid_coreset(rows, K, Uniform(4), "label", tau=TAU, pid=pid(rows)).select("pid", "center_id", "id")


@query()
def coreset_transversal(spark, sf_dir):
    rows = points(spark, sf_dir).withColumn("sets", F.array("label", F.pmod(F.col("label").cast("long") + F.col("id"), F.lit(10)).cast("string")))
    return coresets.matroid_coreset(rows, K, Transversal(), "sets", tau=TAU, pid=pid(rows)).select("pid", "role", "center_id", "id")


@query()
def coreset_to_radius(spark, sf_dir):
    rows = points(spark, sf_dir)
    return coresets.matroid_coreset(rows, K, Partition(CAPS), "label", to_radius=1.0, pid=pid(rows)).select("pid", "role", "center_id", "id")


@query()
def coreset_local_search(spark, sf_dir):
    rows = points(spark, sf_dir)
    return coresets.local_search_coreset(rows, K, pid=pid(rows)).select("pid", "id")


@query()
def diverse_rows(spark, sf_dir):
    """The whole flow: parts, coresets, their union made sparse, local search under caps."""
    rows = points(spark, sf_dir)
    return flows.map_reduce(rows, K, TAU, Partition(CAPS), "label", sparse_tau=TAU).solution


@query(f"WITH {POINTS} SELECT CAST(id AS BIGINT) AS id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS rc FROM p) WHERE rc <= 2 ORDER BY id LIMIT {K}")
def greedy_independent(spark, sf_dir):
    return coresets.greedy_in_sql(points(spark, sf_dir), K, Partition(CAPS)).select("id", "label")


# --- partitions and statistics ----------------------------------------------------------------------------------


@query("SELECT CAST(floor((CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END) / (2 * pi()) * 8) AS BIGINT) AS pid, count(*) AS n FROM (SELECT value - (SELECT avg(value) FROM events) AS x, CAST(extract(hour FROM ts) AS DOUBLE) - 11.5 AS y FROM events) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1")
def partition_polar2d(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mean = e.agg(F.avg("value").alias("m"))
    vec = e.crossJoin(F.broadcast(mean)).select(F.array(F.col("value") - F.col("m"), F.hour("ts").cast("double") - 11.5).alias("vec")).filter("vec[0] IS NOT NULL AND vec[1] IS NOT NULL")
    return statistics.counted(vec, partitioning.by_angle(F.col("vec"), 8)).withColumnRenamed("label", "pid")


@query("SELECT CAST(least(9, floor(l_discount * 10)) * 10 + least(9, floor(l_tax * 10)) AS BIGINT) AS pid, count(*) AS n FROM lineitem WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL GROUP BY 1")
def partition_unit_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_discount IS NOT NULL AND l_tax IS NOT NULL").select(F.array("l_discount", "l_tax").alias("vec"))
    return statistics.counted(rows, partitioning.by_grid(F.col("vec"), 10, unit=True)).withColumnRenamed("label", "pid")


@query(f"WITH {POINTS}, v AS (SELECT vec[1:2] AS vec FROM p) SELECT CAST(floor(sqrt(list_dot_product(vec, vec)) / 0.8 * 16) AS BIGINT) AS pid, count(*) AS n FROM v GROUP BY 1")
def partition_radius(spark, sf_dir):
    rows = points(spark, sf_dir).select(F.slice("vec", 1, 2).alias("vec"))
    return statistics.counted(rows, partitioning.by_radius(F.col("vec"), 16, 0.8)).withColumnRenamed("label", "pid")


@query(f"WITH {POINTS}, o AS (SELECT vec FROM p ORDER BY id LIMIT 1), d AS (SELECT list_distance(p.vec, o.vec) AS d FROM p, o), e AS (SELECT min(d) AS lo, max(d) AS hi FROM d) SELECT CAST(least(99, floor((d - lo) / (hi - lo) * 100)) AS INT) AS bucket, count(*) AS n FROM d, e GROUP BY 1")
def distance_histogram(spark, sf_dir):
    rows = points(spark, sf_dir)
    origin = rows.orderBy("id").select("vec").head()
    return statistics.histogram(rows.select(metrics.euclidean(F.col("vec"), metrics.literal(origin.vec)).alias("d")), "d").select("bucket", "n")


@query("SELECT p_brand AS label, count(*) AS n FROM part GROUP BY 1")
def category_histogram(spark, sf_dir):
    return statistics.counted(table(spark, sf_dir, "part"), F.col("p_brand"))


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 5)")
def category_filter(spark, sf_dir):
    """Rows of the categories with a cap above 0, by semi join."""
    part = table(spark, sf_dir, "part")
    caps = statistics.counted(part, F.col("p_brand")).orderBy(F.desc("n"), "label").limit(5).select("label", F.lit(2).alias("cap"))
    return statistics.admitted_by_cap(part, "p_brand", caps).select("p_partkey", "p_brand")


@query("WITH s AS (SELECT p_partkey, list_filter(string_split(p_type, ' '), lambda x: x IN ('STEEL', 'BRASS', 'SMALL', 'LARGE')) AS kept FROM part) SELECT CAST(p_partkey AS BIGINT) AS p_partkey, array_to_string(list_sort(list_distinct(kept)), ',') AS kept FROM s WHERE len(kept) > 0")
def category_admission(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").alias("kept"))
    return statistics.admitted(rows, "kept", ["STEEL", "BRASS", "SMALL", "LARGE"]).select("p_partkey", F.array_join(F.array_sort("kept"), ",").alias("kept"))


@query(f"WITH {POINTS}, o AS (SELECT vec FROM p ORDER BY id LIMIT 1) SELECT CAST(id AS BIGINT) AS id FROM p, o WHERE acos(least(1.0, greatest(-1.0, list_dot_product(p.vec, o.vec) / (sqrt(list_dot_product(p.vec, p.vec)) * sqrt(list_dot_product(o.vec, o.vec)))))) / pi() < 0.45")
def radius_select(spark, sf_dir):
    rows = points(spark, sf_dir)
    first = rows.agg(F.min("id")).head()[0]
    return selection.within(rows, first, 0.45, lambda c: metrics.cosine_full(F.col("vec"), metrics.literal(c.vec))).select("id")


# --- texts ------------------------------------------------------------------------------------------------------

_BAGS = f"WITH {WORDS}, o AS (SELECT word, n FROM w WHERE doc_id = (SELECT min(doc_id) FROM w)), t AS (SELECT doc_id, sum(n) AS s, sum(n * n) AS q FROM w GROUP BY doc_id), os AS (SELECT sum(n) AS s, sum(n * n) AS q FROM o), x AS (SELECT w.doc_id, sum(least(w.n, o.n)) AS lo, sum(w.n * o.n) AS dot FROM w JOIN o USING (word) GROUP BY w.doc_id)"


@query(f"{_BAGS} SELECT t.doc_id, round(1 - coalesce(lo, 0) / (t.s + os.s - coalesce(lo, 0)), 4) AS jaccard, round(sqrt(t.q + os.q - 2 * coalesce(dot, 0)), 4) AS euclidean, round(2 * acos(least(1.0, coalesce(dot, 0) / (sqrt(t.q) * sqrt(os.q)))) / pi(), 4) AS cosine FROM t LEFT JOIN x USING (doc_id), os")
def bag_distances(spark, sf_dir):
    """Generalized Jaccard, Euclidean and angular distance from every document's bag of words to the first one's."""
    rows = text.bags(table(spark, sf_dir, "documents").select("doc_id", "text")).filter(F.size("bag") > 0)
    first = F.broadcast(rows.orderBy("doc_id").limit(1).select(F.col("bag").alias("first")))
    return rows.crossJoin(first).select("doc_id", *[r4(f(F.col("bag"), F.col("first")), n) for n, f in metrics.BAG_METRICS.items()])


@query(f"WITH {WORDS} SELECT doc_id, count(*) AS n_words FROM w GROUP BY doc_id HAVING count(*) > 100")
def bow_bigger(spark, sf_dir):
    rows = text.bags(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return statistics.transformed(rows, "bigger(100)").select("doc_id", F.size("bag").cast("long").alias("n_words"))


@query(f"WITH {WORDS}, v AS (SELECT word FROM w GROUP BY word ORDER BY sum(n) DESC, word LIMIT 2) SELECT DISTINCT doc_id FROM w JOIN v USING (word)")
def bow_containing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    top = [r.word for r in text.vocabulary(text.word_counts(docs), 2).collect()]
    return statistics.transformed(text.bags(docs), f"bigger(0), containing({';'.join(top)})").select("doc_id").distinct()


@query(f"WITH {WORDS} SELECT word, count(*) AS df, CAST(sum(n) AS BIGINT) AS total, round(ln((SELECT count(*) FROM documents) / count(*)), 4) AS idf FROM w GROUP BY word")
def idf_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return text.idf(text.word_counts(docs), docs.count()).select("word", "df", "total", r4(F.col("idf"), "idf"))


@query(f"WITH {WORDS}, f AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM w GROUP BY word ORDER BY sum(n) DESC, word LIMIT 262144) SELECT doc_id, w.word, round(n * idf, 4) AS weight FROM w JOIN f USING (word)")
def tfidf_weights(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = text.word_counts(docs)
    weights = positions(text.idf(counts, docs.count(), smoothed=True), F.desc("total"), "word").filter(F.col("pos") < 1 << 18)
    return text.tf_idf(counts, F.broadcast(weights)).select("doc_id", "word", r4(F.col("weight"), "weight"))


@query(f"WITH {WORDS} SELECT word, count(*) AS df, CAST(sum(n) AS BIGINT) AS total FROM w GROUP BY word ORDER BY total DESC, word LIMIT 100")
def vocab_topk(spark, sf_dir):
    return text.vocabulary(text.word_counts(table(spark, sf_dir, "documents")), 100)


@query("WITH l AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS i FROM (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS word FROM part)), x AS (SELECT p_partkey, generate_subscripts(string_split(p_type, ' '), 1) AS k, unnest(string_split(p_type, ' ')) AS word FROM part) SELECT CAST(p_partkey AS BIGINT) AS p_partkey, string_agg(CAST(i AS VARCHAR), ',' ORDER BY k) AS numbers, string_agg(word, ' ' ORDER BY k) AS back FROM x JOIN l USING (word) GROUP BY p_partkey")
def category_index(spark, sf_dir):
    """Labels to numbers and back."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").alias("labels"))
    index = text.CategoryIndex.fit(rows, "labels")
    both = index.inverse(index.transform(rows, "labels", "numbers"), "numbers", "back")
    return both.select("p_partkey", F.array_join(F.transform("numbers", lambda i: i.cast("string")), ",").alias("numbers"), F.array_join("back", " ").alias("back"))


def ranked_vectors(spark: SparkSession, sf_dir: str, counts: DataFrame) -> DataFrame:
    """``(word, vec, rank)``: every vector of the embeddings, given to the word of its rank by count."""
    known = points(spark, sf_dir)
    return text.ranked(counts).join(known, F.col("rank") == F.col("id")).select("word", "vec", "rank")


@query(f"WITH {WORDS}, v AS (SELECT word, row_number() OVER (ORDER BY total DESC, word) - 1 AS i FROM (SELECT word, sum(n) AS total FROM w GROUP BY word)), e AS (SELECT word, CAST(embedding AS DOUBLE[]) AS vec FROM v JOIN embeddings ON vec_id = i), m AS (SELECT doc_id, sum(n) AS s, sum(n * vec[1]) AS x, sum(n * vec[2]) AS y FROM w JOIN e USING (word) GROUP BY doc_id) SELECT doc_id, round(x / s, 4) + 0.0 AS x, round(y / s, 4) + 0.0 AS y FROM m")
def mean_word_vector(spark, sf_dir):
    """Mean vector of each document's known words; the most frequent words take the vectors of the embeddings by rank."""
    counts = text.word_counts(table(spark, sf_dir, "documents"))
    vecs = ranked_vectors(spark, sf_dir, counts)
    return text.mean_vectors(counts, vecs).select("doc_id", r4(F.element_at("vec", 1), "x"), r4(F.element_at("vec", 2), "y"))


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, 'may refer to:|can refer to:|may mean:') AND trim(text) <> trim(source)")
def title_only_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return text.without_title_only(text.without_disambiguation(docs), title="source").select("doc_id")


@query(f"WITH {WORDS}, v AS (SELECT word, sum(n) AS n FROM w GROUP BY word), {porter('v')} SELECT stem, CAST(sum(n) AS BIGINT) AS n FROM stems JOIN v USING (word) GROUP BY stem")
def stem_tokens(spark, sf_dir):
    docs = ready(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = docs.select(F.explode(text.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # each word of the table is stemmed once, so a Python worker sees words and no texts
    return words.select(stems(F.array("word")).alias("s"), "n").select(F.get("s", F.lit(0)).alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("n"))


@query()
def topic_threshold(spark, sf_dir):
    """Topics of at least a tenth of each document, by an LDA model of all documents with the operator's own parameters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("words")).filter(F.size("words") > 0)
    return text.topics(docs, "words")[0].select("doc_id", "topic")


_TAGLESS = "coalesce(html, '')"
for _pattern, _to in [("<!--.*?-->", "' '"), ("|".join(rf"<{t}\b.*?</{t}\s*>" for t in ("script", "style", "noscript", "head")), "' '"), (r"<(br|/p|/div|/h[1-6]|/li|/tr)\b[^>]*>", "chr(10)"), ("<[^>]*>", "' '"), (r"[ \t\x0B\f\r]+", "' '"), (r" ?\n ?", "chr(10)"), (r"\n{2,}", "chr(10)"), (r"^\s+|\s+$", "''")]:
    _TAGLESS = f"regexp_replace({_TAGLESS}, '{_pattern}', {_to}, 'gsi')"
# the entities of the table; the ampersand last, so that none is made of two
for _entity, _sign in (("copy", 169), ("middot", 183), ("quot", 34), ("lt", 60), ("gt", 62), ("amp", 38)):
    _TAGLESS = f"replace({_TAGLESS}, '&{_entity};', chr({_sign}))"


@query(f"SELECT page_id, {_TAGLESS} AS text FROM pages")
def html_clean(spark, sf_dir):
    """Text of raw pages without tags, comments, scripts and entities."""
    pages = ready(table(spark, sf_dir, "pages"))
    return pages.select("page_id", unescape(clean_html(F.col("html"))).alias("text"))
