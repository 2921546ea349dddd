"""The command line, each command over a small table, and what the library gained beside it."""

from __future__ import annotations

import numpy as np
import pytest
from dispersa import __main__ as cli
from dispersa.functions import markup
from dispersa.operators import selection, text
from dispersa.sources import files
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=3).tolist(), "ab"[i % 2] + " x") for i in range(60)]
    files.write_points(spark.createDataFrame(rows, "id long, vec array<double>, label string"), f"{root}/points", {"dim": 3})
    (root / "caps").write_text("a_x 2\nb_x 1\n")
    (root / "lines").write_text("0,0\n3,4\n0,4\n")
    (root / "docword.t.txt").write_text("2\n2\n3\n1 1 2\n1 2 1\n2 2 5\n")
    (root / "vocab.t.txt").write_text("alpha\nbeta\n")
    (root / "docs.json").write_text('{"doc_id": 1, "text": "red green red"}\n{"doc_id": 2, "text": "green blue"}\n')
    (root / "dump.xml").write_text("<mediawiki><page><title>A_b</title><ns>0</ns><id>1</id><revision><id>1</id><text>'''One''' {{t}} [[Category:In]]</text></revision></page><page><title>C</title><ns>0</ns><id>2</id><revision><id>1</id><text>Two [[Category:Out]]</text></revision></page><page><title>Template:T</title><ns>10</ns><id>3</id><revision><id>1</id><text>more</text></revision></page></mediawiki>")
    (root / "categories").write_text("# comment\nIn\n^Out\n")
    return root


def run(spark, folder, *argv):
    out = f"{folder}/out-{abs(hash(argv))}"
    cli.main([*argv, "--out", out], spark)
    return spark.read.json(out).collect()


def test_commands(spark, folder):
    points = f"{folder}/points"
    for algorithm in ("mapreduce", "sequential", "traversal", "random"):
        got = run(spark, folder, "select", points, "-k", "4", "--algorithm", algorithm, "--tau", "8")
        assert len({r.id for r in got}) == 4
    capped = run(spark, folder, "select", points, "-k", "3", "--tau", "8", "--label", "label", "--caps", f"{folder}/caps")
    assert sorted(r.id % 2 for r in capped) == [0, 0, 1]
    far = run(spark, folder, "diameter", points)[0]
    want = selection.pair_distances(files.read_points(spark, points)).orderBy(F.desc("distance")).head()
    assert (far.a, far.b) == (want.a, want.b)
    assert 0 < len(run(spark, folder, "subset", points, "--of", "1", "--radius", "1.5")) < 60
    assert {r.label: r.n for r in run(spark, folder, "stats", points, "--label", "label")} == {"a x": 30, "b x": 30}
    assert sum(r.n for r in run(spark, folder, "stats", points, "--buckets", "5")) == 60
    assert len(run(spark, folder, "sample", points, "-n", "60")) == 60
    assert [r.key for r in run(spark, folder, "metadata", points)] == ["dim"]
    made = run(spark, folder, "generate", f"{folder}/made", "--kinds", "uniform-cube", "--ns", "20", "30", "--dims", "2", "--ks", "3")
    assert sorted(files.read_points(spark, r.path).count() for r in made) == [20, 30]
    assert {(r.doc_id, r.word, r.n) for r in run(spark, folder, "docword", str(folder), "--name", "t")} == {("1", "alpha", 2.0), ("1", "beta", 1.0), ("2", "beta", 5.0)}
    assert {(r.doc_id, r.word) for r in run(spark, folder, "vectorize", f"{folder}/docs.json")} == {(1, "red"), (1, "green"), (2, "green"), (2, "blue")}
    assert run(spark, folder, "clique", f"{folder}/lines")[0].clique == pytest.approx(12)
    pages = run(spark, folder, "extract", f"{folder}/dump.xml", "--categories", f"{folder}/categories", "--templates", "--base", "u")
    assert [(r.id, r.title, r.text, r.cut, r.url) for r in pages] == [(1, "A b", "One more", False, "u?curid=1")]
    cli.main(["metadata", points], spark)
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)


def test_random_start(spark):
    points = spark.range(50).select("id", F.array(F.col("id").cast("double")).alias("vec"))
    starts = {selection.random_start(points, s) for s in range(8)}
    assert len(starts) > 2 and starts <= set(range(50)) and selection.random_start(points.repartition(5), 3) == selection.random_start(points, 3)
    assert selection.random_start(points.limit(0)) is None


def test_topics_saved(spark, tmp_path):
    docs = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["c", "d"]) for i in range(20)], "doc_id long, words array<string>")
    got, model, words = text.topics(docs, "words", k=2, iterations=5)
    text.save_topics(model, words, spark, f"file://{tmp_path}/topics")
    again, names = text.load_topics(spark, f"file://{tmp_path}/topics")
    assert names == words and sorted(words) == ["a", "b", "c", "d"] and got.count() == 20
    told = {r.topic: r for r in text.describe_topics(again, names, 2).collect()}
    assert set(told) == {0, 1} and all(len(r.words) == 2 and r.weights[0] >= r.weights[1] for r in told.values())


def test_expansion_marks():
    looping = markup.Expander({"Template:A": "x{{A}}"})
    looping.expand("{{A}}")
    assert looping.cut
    long = markup.Expander({"Template:A": "y" * 50}, longest=60)
    assert "{{A}}" in long.expand("{{A}}" * 9) and long.cut
    fine = markup.Expander({"Template:A b": "z"})
    assert fine.expand("{{a_b}}") == "z" and not fine.cut
    assert markup.wiki_text("a<sub>1</sub> __NOCC__ [sftp://h/x label] b") == "a label b"
