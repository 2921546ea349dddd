"""The doubling algorithm, its streaming form, file formats, generators, stemming and markup."""

from __future__ import annotations

import bz2

import numpy as np
import pytest
from dispersa.functions import markup, stemmer
from dispersa.functions.metrics import matrix
from dispersa.operators import kernels, text
from dispersa.operators.frames import ready
from dispersa.operators.matroids import Partition
from dispersa.sources import files, generators
from dispersa.streaming import doubling, queries
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1, allow_nan=False), min_size=2, max_size=120), st.integers(1, 12), st.integers(1, 4))
def test_doubling_invariants(values, tau, delegates):
    machine = doubling.DoublingCoreset(tau, delegates)
    for i, v in enumerate(values):
        machine.update(i, [v])
        assert len(machine.centres) <= tau + 1
        if machine.started:
            assert machine.threshold <= machine.farness() + 1e-12
    machine.finish()
    centres = np.array([c[1] for c in machine.centres])
    assert 1 <= len(centres) <= max(tau, len(values) if not machine.started else tau)
    if machine.started and machine.threshold > 0:
        far = np.abs(np.array(values)[:, None] - centres[:, 0][None]).min(axis=1).max()
        assert far <= 4 * machine.threshold + 1e-9
    assert all(len(rows) <= delegates for rows in machine.kept)
    again = doubling.DoublingCoreset(tau, delegates).load(machine.dump())
    assert list(again.rows()) == list(machine.rows())


def test_doubling_start_and_labels():
    machine = doubling.DoublingCoreset(3, 2)
    for i, v in enumerate([0.0, 10.0, 3.0, 7.5]):
        assert machine.update(i, [v])
    assert machine.started and machine.threshold == 2.5 and machine.kernel() == [0, 1, 2, 3]
    machine.update(4, [0.1])
    assert len(machine.kernel()) <= 3 and machine.restructurings >= 1
    some = doubling.DoublingCoreset(2, metric="euclidean", matroid=Partition({"a": 1, "b": 1}), k=2)
    for i in range(40):
        some.update(i, [float(i % 20)], "ab"[i % 2])
    kept = some.kernel() + some.delegates()
    assert len(kept) == len(set(kept)) < 12


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(200, 2)))]
    data = spark.createDataFrame(rows, "id long, vec array<double>").orderBy("id")
    for part in range(4):
        data.filter(f"id DIV 50 = {part}").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema("id long, vec array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = doubling.latest(queries.run_once(doubling.stream_coreset(stream, 6, 2, shards=1), f"file://{tmp_path}")).collect()
    machine = doubling.DoublingCoreset(6, 2)
    for i, v in rows:
        machine.update(i, v)
    machine.finish()
    assert out and {r.version for r in out} == {4}
    assert len([r for r in out if r.role == "kernel"]) <= 6
    d = matrix("euclidean", np.array([v for _, v in rows]))
    assert d[:, [r.id for r in out if r.role == "kernel"]].min(axis=1).max() <= 4 * out[0].threshold
    assert doubling.latency([{"numInputRows": 5, "durationMs": {"triggerExecution": 100}}])["rows_per_s"] == pytest.approx(50)


def test_points_and_metadata(spark, tmp_path):
    paths = generators.generate_all(spark, ["uniform-sphere", "uniform-cube"], [50], [3], [4], str(tmp_path))
    assert paths[0].endswith("uniform-sphere-3-50-4.points") and files.read_points(spark, paths[0]).count() == 50
    assert files.read_metadata(spark, paths[0])["data.dimension"] == 3 and files.read_metadata(spark, str(tmp_path / "none")) == {}
    with pytest.raises(Exception, match="already exists"):
        files.write_points(files.read_points(spark, paths[0]), paths[0])
    files.write_points_text(files.read_points(spark, paths[1]), f"{tmp_path}/text")
    assert len(spark.read.text(f"{tmp_path}/text").head().value.split(",")) == 3
    calls = []
    for _ in range(2):
        assert files.cached(spark, f"{tmp_path}/c", lambda: calls.append(1) or spark.range(3)).count() == 3
    assert len(calls) == 1
    row = files.as_row(spark.createDataFrame([(1, [3.0, 4.0])], "id long, vec array<double>")).head()
    assert row.norm == 5 and row.point == "3.0 4.0"
    files.write_report({"t": spark.range(2)}, {"k": 3}, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report/t").head().tag_k == "3"


@pytest.mark.parametrize("kind", sorted(generators.KINDS))
def test_generators(spark, kind):
    data = generators.generate(spark, kind, 400, 3, 6, seed=2)
    rows = data.collect()
    assert sum(r.certificate for r in rows) == 6 and len(rows) == 400 and [r.vec for r in rows] == [r.vec for r in data.collect()]
    lengths = np.linalg.norm([r.vec for r in rows if not r.certificate], axis=1)
    if kind == "uniform-cube":
        assert all(0 <= x <= 1 for r in rows for x in r.vec)
    else:
        assert lengths.max() <= (0.8 if kind == "chasm-sphere" else 1) + 1e-9
        assert 0.3 < np.median(lengths) / {"uniform-sphere": 0.5, "chasm-sphere": 0.4}.get(kind, 0.17) < 1.7
        chosen = kernels.farthest(np.array([r.vec for r in rows]), 6)[0]
        assert 0.3 < generators.ratios(data, {"edge": [rows[i].id for i in chosen]})["edge"] < 2.1
    with pytest.raises(ValueError):
        generators.generate(spark, "nothing", 1, 1, 1)


def test_text_formats(spark, tmp_path):
    put = lambda name, body: (tmp_path / name).write_text(body) and f"file://{tmp_path}/{name}"
    mxm = put("mxm.txt", "# note\n%i,you,love\nTR1,55,1:3,3:1\nTR2,56,2:2\n")
    bags = files.read_musixmatch(spark, mxm)
    assert {r.doc_id: r.bag for r in bags.collect()} == {"TR1": {"1": 3.0, "3": 1.0}, "TR2": {"2": 2.0}}
    assert [(r.word_id, r.word) for r in files.read_musixmatch_vocabulary(spark, mxm).collect()] == [(1, "i"), (2, "you"), (3, "love")]
    genres = files.read_genres(spark, put("g.tsv", "#x\ty\nTR1\tRock\n"))
    got = {r.track_id: (r.genre, r.vec.toArray().tolist()) for r in files.songs(bags, genres, 3).collect()}
    assert got == {"TR1": ("Rock", [3, 0, 1]), "TR2": ("Unknown", [0, 2, 0])}
    assert [(r.label, r.cap) for r in files.read_caps(spark, put("caps", "Pop_Rock 3\nJazz 0\n")).collect()] == [("Pop Rock", 3), ("Jazz", 0)]
    uci = files.read_docword(spark, put("docword.x.txt", "2\n3\n4\n1 1 2\n1 3 1\n2 2 5\n"))
    assert {r.doc_id: r.bag for r in uci.collect()} == {"1": {"1": 2.0, "3": 1.0}, "2": {"2": 5.0}}
    assert [(r.word_id, r.word) for r in files.read_docword_vocabulary(spark, put("vocab.x.txt", "a\nb\n")).collect()] == [(1, "a"), (2, "b")]
    assert files.docword_paths("/d", "x") == ("/d/docword.x.txt", "/d/vocab.x.txt")
    wiki = files.read_wiki_tsv(spark, put("w.tsv", "A\t[x, y]\tred red car\nB\tz\t0.5\nC\tz\t0.5\tblue sky\nD\tz\ta\n"))
    assert {r.title: (r.categories, r.bag) for r in wiki.collect()} == {"A": (["x", "y"], {"red": 2.0, "car": 1.0}), "C": (["z"], {"blue": 1.0, "sky": 1.0})}
    glove = files.read_embeddings_text(spark, put("glove.txt", "cat 1.0 2.5\ndog 0 -1\n"))
    assert {r.word: r.vec for r in glove.collect()} == {"cat": [1.0, 2.5], "dog": [0.0, -1.0]}
    (tmp_path / "t.json.bz2").write_bytes(bz2.compress(b'{"id":1,"title":"t","topic":[2],"vector":"1.0 0.0"}\n{"id":2,"title":"u","topic":[],"vector":"1"}\n{"id":3,"title":"v","topic":[1],"vector":"0.0 0"}\n'))
    pages = files.read_topic_pages(spark, f"file://{tmp_path}/t.json.bz2")
    assert [(r.id, r.vec) for r in pages.collect()] == [(1, [1.0, 0.0])]
    files.write_topic_pages(pages, f"{tmp_path}/topics")
    assert files.read_topic_pages(spark, f"{tmp_path}/topics").collect() == pages.collect()
    assert files.read_any(spark, f"file://{tmp_path}/t.json.bz2").count() == 3


def test_dump_to_text(spark, tmp_path):
    page = "<page><title>{t}</title><ns>{n}</ns><id>{i}</id>{r}<revision><id>9</id><text>{x}</text></revision></page>"
    pages = [
        page.format(t="Cat", n=0, i=1, r="", x="'''Cats''' are {{size|small}} [[animal|animals]]. [[Category:Pets]] &lt;ref&gt;no&lt;/ref&gt;\n== Food ==\nThey eat [http://x.y fish]."),
        page.format(t="Kitty", n=0, i=2, r='<redirect title="Cat"/>', x="#REDIRECT [[Cat]]"),
        page.format(t="Template:Size", n=10, i=3, r="", x="very {{{1|big}}}&lt;noinclude&gt; doc&lt;/noinclude&gt;"),
    ]
    (tmp_path / "dump.xml").write_text(f"<mediawiki>{''.join(pages)}</mediawiki>")
    rows = files.read_dump(spark, f"file://{tmp_path}/dump.xml")
    templates = markup.collect_templates(rows)
    assert templates == {"Template:Size": "very {{{1|big}}}"}
    got = markup.extract(rows, templates, "http://w").collect()
    assert [(r.id, r.url, r.title) for r in got] == [(1, "http://w?curid=1", "Cat")]
    assert got[0].text == "Cats are very small animals.\nFood.\nThey eat fish."
    assert rows.filter("id = 1").select(markup.dump_categories(F.col("text"))).head()[0] == ["Pets"]
    with pytest.raises(ValueError):
        markup.collect_templates(rows, 3)


def test_templates():
    e = markup.Expander({"Template:A": "[{{{1|x}}}{{{n|}}}]", "Template:B": "{{a|{{{1}}}|n=2}}", "Template:R": "#REDIRECT [[Template:A]]", "Template:Loop": "{{loop}}"}, "Talk:My page")
    cases = {
        "{{a}} {{A|y}} {{b|z}} {{r|q}}": "[x] [y] [z2] [q]",
        "{{#if: x |yes|no}}{{#if: |yes|no}}": "yesno",
        "{{#ifeq:a|a|1|2}}{{#ifeq:a|b|1|2}}": "12",
        "{{#switch: b |a=1|b|c=2|#default=3}}{{#switch: z |a=1|last}}{{#switch: z |a=1|#default=3}}": "2last3",
        "{{#expr: 2 * (3 + 4) div 4 round 1}} {{#expr: 7 mod 3}} {{#expr: 2 ^ 10}} {{#expr: 1 = 1}} {{#expr: not 1}}": "3.5 1 1024 1 0",
        "{{#expr: __import__('os')}}{{#expr: 1/0}}": "",
        "{{uc:ab}}{{lc:AB}}{{ucfirst:ab}}{{lcfirst:AB}}{{urlencode:a b/c}}": "ABabAbaBa+b%2Fc",
        "{{PAGENAME}}|{{NAMESPACE}}": "My page|Talk",
        "{{loop}}{{unknown|1}}": "",
        "{{#invoke:String|len|abc}}{{#invoke:String|sub|hello|2|-2}}{{#invoke:String|rep|ab|3}}{{#invoke:Roman|main|1994}}": "3ellababab" + "MCMXCIV",
        "{{#invoke:String|find|hello|l}}{{#invoke:String|find|hello|l+|plain=false}}{{#invoke:String|replace|aXbX|X|-}}": "33a-b-",
    }
    for source, want in cases.items():
        assert e.expand(source) == want, source


def test_markup_pieces():
    assert markup.wiki_text("a <!-- c -->b {{gone|{{x}}}} [[File:x.png|thumb|[[y]]]] [[cat]]s [[w:Z|z]]\n{| table |}\n* item\n__TOC__\n<math>x</math> '''b''' <nowiki>[[k]]</nowiki> a....... b") == "a b cats z\nformula_1 b [[k]] a... b"
    assert markup.wiki_text("== Empty ==\n== Full ==\n* x\nText &amp; more &#945;", keep_lists=True) == "Full.\n- x\nText & more α"
    assert markup.split_parts("a|{{b|c}}|[[d|e]]|f") == ["a", "{{b|c}}", "[[d|e]]", "f"] and markup.bind(["x", " k = v ", "y"]) == {"1": "x", "k": "v", "2": "y"}
    assert markup.balanced("x(a(b)c)(d", "(", ")") == [(1, 8)]
    assert markup.normal_title("_foo__bar ") == "Foo bar" and markup.normal_title("category: pets", frozenset({"Category"})) == "Category:Pets"
    assert [markup.roman(x, "?") for x in ("4", "2024", "0", "x")] == ["IV", "MMXXIV", "?", "?"]
    assert markup.define_template("a<noinclude>b</noinclude><includeonly>c</includeonly>") == "ac" and markup.define_template("x<onlyinclude>y</onlyinclude>z") == "y"
    inc, exc = markup.category_lists(["# note", "Pets", "^Dogs", ""])
    assert (inc, exc) == ({"Pets"}, {"Dogs"}) and markup.admitted_page(0, {"Pets"}, inc, exc) and not markup.admitted_page(0, {"Pets", "Dogs"}, inc, exc) and not markup.admitted_page(1, set(), set(), set())
    assert markup.unescape_text("&lt;&#65;&#x42;&nope;") == "<AB&nope;"


def test_html(spark):
    frame = ready(spark.createDataFrame([(1, "<html><head><title>t</title></head><!-- x --><p>a &amp; <b>b</b></p><script>1</script><br>c"), (2, None)], "id int, html string"))
    assert [r[0] for r in frame.orderBy("id").select(markup.unescape(markup.clean_html(F.col("html")))).collect()] == ["a & b\nc", ""]


def test_stemmer(spark):
    # Examples of the published algorithm.
    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit digitizer digit operator oper decisiveness decis hopefulness hope formaliti formal triplicate triplic formalize formal electrical electr goodness good revival reviv allowance allow adjustable adjust replacement replac adoption adopt activate activ effective effect probate probat rate rate cease ceas controll control roll roll".split()
    assert {w: stemmer.stem(w) for w in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2], strict=True))
    rows = ready(spark.createDataFrame([(["cats", "cats", "running"],), (None,), ([],)], "w array<string>"))
    assert [r[0] for r in rows.select(stemmer.stems(F.col("w"))).collect()] == [["cat", "cat", "run"], None, []]
    assert text.tokens(F.lit("x")) is not None


def test_cut_entities_stay():
    assert markup.unescape_text("R&amp D &copy &am &amp;lt; &ampx; &semi; &#38 &#38;") == "R&amp D &copy &am &lt; &ampx; ; &#38 &"


def test_dump_of_several_files(spark, sf_dir, monkeypatch):
    """Every file of a dump is whole, and no task takes all pages; before, one file and one task held the dump."""
    from dispersa.plans import library

    monkeypatch.setattr(library, "DUMP_PAGES", 40)
    paths = []
    read = files.read_dump
    monkeypatch.setattr(files, "read_dump", lambda s, path: paths.append(path) or read(s, path))
    assert library.dump_file(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/part.parquet").count()
    found = [r.value for r in spark.read.text(paths[0], wholetext=True).collect()]
    assert len(found) > 1 and all(x.startswith("<mediawiki>") and x.rstrip().endswith("</mediawiki>") for x in found)


def test_pages_of_a_task_fill_several_files(spark, tmp_path):
    """As many files as before, in order by name, from fewer tasks."""
    rows = spark.range(3000).select("id", F.repeat(F.lit("x"), 100).alias("text"))
    files.write_pages(rows, f"{tmp_path}/p", 1000)
    names = sorted(p.name for p in (tmp_path / "p").glob("part-*"))
    assert 300 <= len(names) <= 320 and len({n[:10] for n in names}) <= spark.sparkContext.defaultParallelism
    read = [spark.read.schema("id long, text string").json(f"file://{tmp_path}/p/{n}").select("id").collect() for n in names[:40]]
    assert [r.id for part in read for r in part] == list(range(sum(map(len, read))))


def test_lines_of_wiki_are_counted_where_they_are_read(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("A\tx\t1\tred red car\nA\tx\t1\tred red car\nB\tx\t2\ta b\n")
    got = files.read_wiki_tsv(spark, f"file://{tmp_path}/w.tsv")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.title, r.bag) for r in got.collect()] == [("A", {"red": 2.0, "car": 1.0})] * 2


def test_stems_are_made_of_words_not_of_texts(spark, sf_dir):
    from dispersa.plans import queries as plans

    plan = plans.stem_tokens(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("ArrowEvalPython") < plan.rindex("Aggregate")
