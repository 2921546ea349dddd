"""Operators on DataFrames: odd inputs, plans, and equality with the array versions."""

from __future__ import annotations

import numpy as np
import pytest
from dispersa.functions import metrics
from dispersa.functions.markup import plane_zero
from dispersa.operators import coresets, frames, kernels, partitioning, selection, statistics, text
from dispersa.operators.matroids import Partition, Transversal, Uniform
from dispersa.plans import flows
from dispersa.sources import files
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in x], "abc"[i % 3], ["abc"[i % 3], "abcd"[i % 4]]) for i, x in enumerate(rng.normal(size=(120, 3)))]
    return spark.createDataFrame(rows, "id long, vec array<double>, label string, sets array<string>").repartition(5)


@pytest.fixture(scope="module")
def array(points):
    return np.array([r.vec for r in points.orderBy("id").collect()])


@pytest.mark.parametrize("metric", sorted(metrics.METRICS))
def test_columns_equal_kernels(points, array, metric):
    got = points.orderBy("id").select(metrics.METRICS[metric](F.col("vec"), metrics.literal(array[7]))).collect()
    assert np.allclose([r[0] for r in got], metrics.distances(metric, array, array[7]), atol=1e-7)


def test_traversal_over_table(points, array):
    got = selection.farthest_points(points, 11).orderBy("step").collect()
    chosen, radii, nearest, near = kernels.farthest(array, 11)
    assert [r.id for r in got] == chosen and np.allclose([r.radius for r in got[1:]], radii)
    found = selection.nearest_centre(points, selection.farthest_points(points, 11)).orderBy("id").collect()
    assert np.allclose([r.distance for r in found], near)
    assert sorted(r.id for r in selection.farthest_to_radius(points, 1.2).collect()) == kernels.farthest_to_radius(array, 1.2)


def test_empty_and_equal_tables(spark, points):
    none = points.limit(0)
    assert selection.farthest_points(none, 3).count() == 0 == coresets.coreset(none, 4).count()
    assert selection.nearest_centre(points, none).filter("center_id IS NULL").count() == 120
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(9)], "id long, vec array<double>")
    assert [r.id for r in selection.farthest_points(same, 4).collect()] == [0]
    assert coresets.coreset(same, 4, 3).select("id").collect()[0].id == 0
    with pytest.raises(ValueError):
        selection.farthest_points(points, 2, start=999)
    with pytest.raises(ValueError):
        selection.pair_distances(points, most=5).count()


def test_pairs_two_ways(points):
    a = {(r.a, r.b): r.distance for r in selection.pair_distances(points).collect()}
    b = {(r.a, r.b): r.distance for r in selection.pair_blocks(points, block=32).collect()}
    assert a.keys() == b.keys() and len(a) == 120 * 119 // 2 and np.allclose([a[k] for k in sorted(a)], [b[k] for k in sorted(a)])


def test_objectives(points, array):
    d = metrics.matrix("euclidean", array)
    r = selection.objectives(points).head()
    assert [r.edge, r.clique, r.star] == pytest.approx([kernels.edge(d), kernels.clique(d), kernels.star(d)])
    assert selection.tree_weight(points).head().tree == pytest.approx(kernels.tree(d))
    assert selection.contribution(points, 3).head().total == pytest.approx(d[3].sum())


def test_coreset_anticover_and_delegates(points, array):
    got = coresets.coreset(points, 8, 3, pid=F.lit(0)).collect()
    kernel = [r.id for r in got if r.role == "kernel"]
    assert kernel == kernels.farthest(array, 8)[0] and len({r.id for r in got}) == len(got)
    d = metrics.matrix("euclidean", array)
    assert got[0].radius == pytest.approx(d[:, kernel].min(axis=1).max())
    assigned = selection.nearest_centre(points, selection.farthest_points(points, 8))
    sql = coresets.delegates_in_sql(assigned, 3)
    assert {(r.center_id, r.id) for r in sql.collect()} == {(r.center_id, r.id) for r in got if r.role == "delegate"}
    assert coresets.coreset(points, 500, 2, pid=F.pmod("id", F.lit(3))).count() == 120


@pytest.mark.parametrize(("matroid", "label"), [(Partition({"a": 2, "b": 1}), "label"), (Uniform(3), "label"), (Transversal(), "sets")])
def test_matroid_coreset_and_flow(points, matroid, label):
    core = coresets.matroid_coreset(points, 4, matroid, label, tau=6, pid=F.pmod("id", F.lit(2)))
    assert core.count() >= 12
    out = flows.map_reduce(points, 3, 6, matroid, label, parts=2, sparse_tau=6)
    ids = [r.id for r in out.solution.collect()]
    labels = [r[0] for r in points.filter(F.col("id").isin(ids)).select(label).collect()]
    assert len(ids) == 3 and matroid.independent(labels)
    assert {"coreset", "sparse", "search"} == set(out.seconds)
    assert set(flows.report(out, points)) == {"solution", "value", "times"}
    whole = flows.sequential(points, 3, matroid=matroid, label=label).solution.head().value
    assert out.solution.head().value >= 0.5 * whole


def test_greedy_windows_equal_scan(points):
    rows = points.orderBy("id").collect()
    for m in (Partition({"a": 2, "b": 1}), Uniform(4), Partition({})):
        want = [rows[i].id for i in m.greedy([r.label for r in rows], 5)]
        assert sorted(r.id for r in coresets.greedy_in_sql(points, 5, m).collect()) == want


def test_merge_and_shrink(points):
    a, b = coresets.coreset(points.filter("id < 70"), 5, 2), coresets.coreset(points.filter("id >= 50"), 5, 2)
    both = coresets.merge(a, b).collect()
    assert len({r.id for r in both}) == len(both) and len({r.radius for r in both}) == 1
    assert coresets.shrink(points, 4, most=40, rows_per_part=30).count() <= 40
    assert coresets.local_search_coreset(points, 3, rows_per_part=40).groupBy("pid").count().filter("count = 3").count() == 3


def test_random_choices_repeat(points):
    ids = lambda d: [r.id for r in d.collect()]
    assert ids(selection.random_rows(points, 5, 1)) == ids(selection.random_rows(points, 5, 1)) != ids(selection.random_rows(points, 5, 2))
    with pytest.raises(ValueError):
        selection.bernoulli_rows(points, 100, 0.01)
    assert selection.bernoulli_rows(points, 5, 0.5).count() == 5
    rows, tries = selection.random_independent(points, 2, Partition({"a": 1, "b": 1, "c": 1}), "label")
    assert rows.count() == 2 and tries >= 1
    with pytest.raises(ValueError):
        selection.random_independent(points, 2, Partition({}), "label", tries=3)


def test_positions(points):
    got = frames.positions(points.select("id", "label"), "label", "id").orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(120)) and [(r.label, r.id) for r in got] == sorted((r.label, r.id) for r in got)


def test_partitions(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, -1.0]), (5, [1.0, 1.0])], "id long, vec array<double>")
    get = lambda c: [r[0] for r in rows.orderBy("id").select(c).collect()]
    assert get(partitioning.by_angle(F.col("vec"), 4)) == [0, 1, 2, 3, 0]
    assert get(partitioning.by_radius(F.col("vec"), 4)) == [4, 4, 4, 4, 5]
    assert get(partitioning.by_grid(F.col("vec"), 4)) == [3 * 4 + 2, 2 * 4 + 3, 2, 2 * 4, 15]
    assert partitioning.deal(rows, partitioning.by_hash(3), 3).filter("pid NOT BETWEEN 0 AND 2").count() == 0
    assert partitioning.sampled(rows, 100).count() == 5 and partitioning.shuffled(rows).count() == 5


def test_histogram(spark):
    rows = spark.createDataFrame([(float(v),) for v in [0, 0, 1, 5, 9.99, 10, float("nan")]] + [(None,)], "d double")
    assert {r.bucket: r.n for r in statistics.histogram(rows, "d", 10).collect()} == {0: 2, 1: 1, 5: 1, 9: 2}
    assert [r.n for r in statistics.histogram(rows.filter("d = 0"), "d").collect()] == [2]
    assert statistics.histogram(rows.limit(0), "d").count() == 0


def test_transformations(spark):
    rows = spark.createDataFrame([(1, {"a": 1.0, "b": 2.0}), (2, {"c": 1.0}), (3, {})], "id long, bag map<string,double>")
    assert [r.id for r in statistics.transformed(rows, "bigger(0), containing(a;c)").collect()] == [1, 2]
    assert [r.id for r in statistics.transformed(rows, "bigger(1)").collect()] == [1] and statistics.transformed(rows, "").count() == 3
    with pytest.raises(ValueError):
        statistics.transformed(rows, "smaller(1)")
    seen_rows, seen = statistics.observed(rows, "n")
    seen_rows.collect()
    assert seen.get["rows"] == 3
    got = rows.crossJoin(rows.filter("id = 1").select(F.col("bag").alias("b"))).orderBy("id").select(*[f(F.col("bag"), F.col("b")) for f in metrics.BAG_METRICS.values()]).collect()
    assert list(got[0]) == pytest.approx([0, 0, 0], abs=1e-6) and list(got[1]) == pytest.approx([6**0.5, 1, 1]) and np.isnan(got[2][2])
    zero = rows.select(metrics.cosine_full(metrics.literal([0, 0]), metrics.literal([1, 0]))).head()[0]
    assert np.isnan(zero)
    assert rows.filter("id = 1").select(metrics.bag_score(F.col("bag"), "b"), metrics.bag_score(F.col("bag"), "z")).head() == (2.0, 0.0)


def test_text_weights(spark):
    docs = spark.createDataFrame([(1, "aa aa bb"), (2, "BB cc?"), (3, None), (4, "x")], "doc_id long, text string")
    counts = text.word_counts(docs)
    assert {(r.doc_id, r.word): r.n for r in counts.collect()} == {(1, "aa"): 2, (1, "bb"): 1, (2, "bb"): 1, (2, "cc"): 1}
    assert {r.word: round(r.idf, 6) for r in text.idf(counts, 4).collect()} == {"aa": round(np.log(4), 6), "bb": round(np.log(2), 6), "cc": round(np.log(4), 6)}
    assert [r.word for r in text.vocabulary(counts, 2).collect()] == ["aa", "bb"] and [r.word for r in text.vocabulary(counts, 9, 2).collect()] == ["bb"]
    weights = text.idf(counts, 4, smoothed=True)
    got = {(r.doc_id, r.word): r.weight for r in text.tf_idf(counts, weights, 2).collect()}
    assert got == {(1, "aa"): pytest.approx(2 * np.log(5 / 2))}
    vocab = spark.createDataFrame([("aa", 0), ("bb", 1), ("cc", 2)], "word string, index int")
    assert text.vectors(text.tf_idf(counts, weights), vocab).filter("doc_id = 1").head().vec.size == 3
    assert {r.doc_id: len(r.bag) for r in text.bags(docs).collect()} == {1: 2, 2: 2, 3: 0, 4: 0}
    vecs = spark.createDataFrame([("aa", [1.0, 0.0]), ("bb", [0.0, 4.0])], "word string, vec array<double>")
    assert {r.doc_id: r.vec for r in text.mean_vectors(counts, vecs).collect()} == {1: [pytest.approx(2 / 3), pytest.approx(4 / 3)], 2: [0.0, 4.0]}
    assert text.mean_vectors(counts, vecs, weighted=True).filter("doc_id = 1").head().vec == [1.0, 2.0]


def test_category_index(spark):
    rows = spark.createDataFrame([(1, ["b", "a"]), (2, []), (3, None)], "id long, c array<string>")
    index = text.CategoryIndex.fit(rows, "c")
    out = index.inverse(index.transform(rows, "c", "n"), "n", "back").orderBy("id").collect()
    assert [r.n for r in out] == [[1, 0], [], None] and [r.back for r in out] == [["b", "a"], [], None]
    with pytest.raises(Exception, match="unknown label"):
        text.CategoryIndex(["a"]).transform(rows, "c", "n").collect()
    with pytest.raises(ValueError):
        index.transform(rows, "missing", "n")
    with pytest.raises(ValueError):
        index.transform(rows, "c", "id")


def test_filters(spark):
    rows = spark.createDataFrame([(1, " T ", "T", [0.0, 0.0]), (2, "T may refer to: x", "T", [1.0, 0.0]), (3, "long text", "T", [1.0, 2.0])], "id long, text string, title string, vec array<double>")
    assert [r.id for r in text.without_title_only(text.without_disambiguation(rows)).collect()] == [3]
    assert [r.id for r in text.useful_vectors(rows).collect()] == [2, 3] and [r.id for r in text.useful_vectors(rows, least=2).collect()] == [3]
    words = rows.select("id", F.split("text", " ").alias("w"))
    assert text.without_stop_words(words, "w", ["long"]).filter("id = 3").head().w == ["text"]
    assert [r[0] for r in spark.createDataFrame([(["a1", "--", "-lrb-", "b"],)], "w array<string>").select(text.cleaned_tokens(F.col("w"))).collect()] == [["a1", "b"]]


def test_models(spark):
    docs = spark.createDataFrame([(i, ["aa", "bb"] if i % 2 else ["cc", "dd"]) for i in range(40)], "id long, w array<string>")
    topics, _, vocabulary = text.topics(docs, "w", k=2, iterations=10)
    assert sorted(vocabulary) == ["aa", "bb", "cc", "dd"] and topics.filter(F.size("topic") == 0).count() == 0
    assert len(text.word_vectors(docs, "w", size=4, share=1.0, least=1)[0].head().vec) == 4


def test_filter_reaches_the_scan(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_size > 40").select("p_partkey")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,40)]" in plan and "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan


def test_character_references_and_bags_as_text(spark):
    rows = spark.createDataFrame([("&#233;",), ("&#65535;",), ("&#65536;",), ("&#99999999999999999999;",), ("&amp;",), ("",), (None,)], "r string")
    assert [r.c for r in rows.select(plane_zero(F.col("r")).alias("c")).collect()] == ["\u00e9", "\uffff", "", None, None, None, None]
    bags = spark.createDataFrame([({"b": 2.0, "a": 1.0},), ({},), (None,)], "bag map<string,double>")
    assert [r.t for r in bags.select(text.bag_text(F.col("bag")).alias("t")).collect()] == ["[a -> 1, b -> 2]", "[]", None]


def test_pages_in_order_of_an_empty_table(spark, tmp_path):
    files.write_pages(spark.createDataFrame([], "id long, text string"), f"{tmp_path}/none")
    assert spark.read.schema("id long, text string").json(f"{tmp_path}/none").count() == 0


def test_topics_are_inferred_once_a_row(spark):
    rows = spark.createDataFrame([(i, [["red"] * 5 + ["blue"] * 4, ["cat"] * 3 + ["dog"] * 2][i % 2]) for i in range(8)], "id long, w array<string>")
    got, model, _ = text.topics(rows, "w", k=5, iterations=2, least_score=0.3, size=10)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    assert not any("lambdafunction" in line and "element_at(UDF" in line for line in plan.splitlines())
    counted = CountVectorizer(inputCol="w", outputCol="c", vocabSize=10).fit(rows).transform(rows)
    want = model.setFeaturesCol("c").setTopicDistributionCol("t").transform(counted).select("id", vector_to_array("t").alias("t")).collect()
    assert {r.id: r.topic for r in got.collect()} == {r.id: [i for i, x in enumerate(r.t) if x >= 0.3] for r in want}


def test_all_pairs_in_bounded_memory(spark, points):
    """Results of a plain form, rows of equal ids and of equal vectors included, and no bound on the number of rows."""
    rng = np.random.default_rng(3)
    rows = [(i // 2 if i < 20 else i, [float(v) for v in np.round(x, 1)]) for i, x in enumerate(rng.normal(size=(900, 2)))]
    table = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    plain = selection.pair_distances(table)
    for k in (1, 40):
        want = plain.orderBy(F.desc("distance"), "a", "b").limit(k).collect()
        assert [(r.a, r.b) for r in selection.top_pairs(table, k, block=200).collect()] == [(r.a, r.b) for r in want]
    want = {r.bucket: r.n for r in statistics.histogram(plain, "distance", 20).collect()}
    got = selection.pair_histogram(table, 20, block=200).collect()
    assert {r.bucket: r.n for r in got} == want and min(r.left for r in got) == 0
    assert selection.pair_histogram(table.limit(1), 20).count() == 0
    many = spark.range(200_001).select("id", F.array(F.col("id").cast("double")).alias("vec"))
    assert selection.top_pairs(many, 1, block=100_001).columns == ["a", "b", "distance"]  # refused before


def test_words_are_counted_where_they_are_read(spark):
    docs = spark.createDataFrame([(i, "b a b cé a b" if i % 2 else ["", None, "x"][i // 2 % 3]) for i in range(12)], "doc_id long, text string").repartition(3)
    for frame in (text.word_counts(docs), text.bags(docs)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert not any(x in plan for x in ("Aggregate", "Join"))  # words were shuffled, and texts too for bags
    docs = docs.withColumn("text", F.replace(F.replace("text", F.lit("a"), F.lit("aa")), F.lit("b"), F.lit("bb")))
    assert {(r.doc_id, r.word): r.n for r in text.word_counts(docs).collect()} == {(i, w): n for i in range(1, 12, 2) for w, n in (("aa", 2), ("bb", 3), ("cé", 1))}
    twice = docs.unionByName(docs.filter("doc_id < 2"))  # a document in two rows is still one
    assert {(r.doc_id, r.word): r.n for r in text.word_counts(twice).filter("doc_id < 4").collect()} == {(i, w): n * (2 if i == 1 else 1) for i in (1, 3) for w, n in (("aa", 2), ("bb", 3), ("cé", 1))}
    assert [len(r.bag) for r in text.bags(twice).filter("doc_id < 2").orderBy("doc_id").collect()] == [0, 0, 3, 3]


def test_vectors_beyond_those_held(spark):
    """Means are the same whether tasks hold all vectors, some or none; before, each count was moved with its vector."""
    docs = spark.createDataFrame([(i, " ".join("abcdefgh"[j] * 2 for j in range(8) for _ in range((i * j) % 3))) for i in range(20)], "doc_id long, text string").repartition(4)
    counts = text.word_counts(docs)
    vecs = spark.createDataFrame([(c * 2, [float(i), i * i / 7]) for i, c in enumerate("abcdefg")], "word string, vec array<double>")
    number = {c * 2: i for i, c in enumerate("abcdefg")}
    known = [(r.doc_id, r.word, r.n) for r in counts.collect() if r.word in number]
    for weighted in (False, True):
        want = {i: sum(n * number[w] for j, w, n in known if j == i) / sum(1 if weighted else n for j, w, n in known if j == i) for i in {j for j, _, _ in known}}
        for held in (100, 3, 0):
            got = {r.doc_id: r.vec for r in text.mean_vectors(counts, vecs, weighted, held).collect()}
            assert got.keys() == want.keys() and all(got[i][0] == pytest.approx(want[i]) for i in want)
    assert [(r.rank, r.word) for r in text.ranked(counts).orderBy("rank").collect()] == [(i, r.word) for i, r in enumerate(text.vocabulary(counts, 99).collect())]
