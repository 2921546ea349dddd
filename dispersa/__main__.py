"""Command line: selections, coresets, statistics, file conversions and the extraction of dumps.

``python -m dispersa COMMAND --help`` tells the options of a command. Tables of points are Parquet with ``id`` and ``vec``.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import markup
from .functions.metrics import METRICS
from .operators import partitioning, selection, statistics, text
from .operators.matroids import Partition
from .plans import flows
from .sources import files, generators

COMMANDS: dict[str, tuple[Callable, Callable]] = {}


def command(options: Callable):
    def add(f):
        COMMANDS[f.__name__.replace("_", "-")] = (options, f)
        return f

    return add


def _show(df: DataFrame, args) -> None:
    """To ``--out`` as JSON lines, or to the console."""
    if args.out:
        df.write.mode("errorifexists").json(args.out)
    else:
        df.show(args.rows, truncate=False)


def _points(p) -> None:
    p.add_argument("path")
    p.add_argument("--metric", choices=sorted(METRICS), default="euclidean")


def _selection(p) -> None:
    _points(p)
    p.add_argument("-k", type=int, default=8)
    p.add_argument("--algorithm", choices=["mapreduce", "sequential", "random", "traversal"], default="mapreduce")
    p.add_argument("--tau", type=int, default=64)
    p.add_argument("--parts", type=int)
    p.add_argument("--sparsify", type=int, help="tau of a second round")
    p.add_argument("--label", help="column of categories")
    p.add_argument("--caps", help="file of caps: label_with_underscores count")
    p.add_argument("--seed", type=int, default=0)


@command(_selection)
def select(spark: SparkSession, args) -> DataFrame:
    """Rows that are far apart, under caps of categories if given."""
    points = files.read_points(spark, args.path, recursive=True)
    matroid = Partition({r.label: r.cap for r in files.read_caps(spark, args.caps).collect()}) if args.caps else None
    if args.algorithm == "traversal":
        return selection.farthest_points(points, args.k, args.metric, selection.random_start(points, args.seed)).drop("vec")
    if args.algorithm == "random":
        return flows.random_choice(points, args.k, args.seed).solution.select("id")
    if args.algorithm == "sequential":
        return flows.sequential(points, args.k, args.metric, matroid, args.label).solution
    return flows.map_reduce(points, args.k, args.tau, matroid, args.label, args.metric, args.parts, args.sparsify).solution


@command(lambda p: (_points(p), p.add_argument("-k", type=int, default=1)))
def diameter(spark: SparkSession, args) -> DataFrame:
    """The farthest pairs."""
    return selection.top_pairs(files.read_points(spark, args.path), args.k, args.metric)


@command(lambda p: (_points(p), p.add_argument("--of", type=int, required=True), p.add_argument("--radius", type=float, required=True)))
def subset(spark: SparkSession, args) -> DataFrame:
    """Rows nearer to one of them than a radius."""
    from .functions.metrics import literal

    return selection.within(files.read_points(spark, args.path), args.of, args.radius, lambda c: METRICS[args.metric](F.col("vec"), literal(c.vec))).select("id", "distance")


@command(lambda p: (_points(p), p.add_argument("--label"), p.add_argument("--buckets", type=int, default=100)))
def stats(spark: SparkSession, args) -> DataFrame:
    """Rows of each label, or a histogram of distances from the row of least id."""
    from .functions.metrics import literal

    points = files.read_points(spark, args.path)
    if args.label:
        return statistics.counted(points, F.col(args.label)).orderBy("n", "label")
    origin = points.orderBy("id").select("vec").head()
    return statistics.histogram(points.select(METRICS[args.metric](F.col("vec"), literal(origin.vec)).alias("d")), "d", args.buckets).orderBy("bucket")


@command(lambda p: (p.add_argument("path"), p.add_argument("-n", type=int, required=True), p.add_argument("--key", default="id"), p.add_argument("--seed", type=int, default=0)))
def sample(spark: SparkSession, args) -> DataFrame:
    """About n rows, each with the same probability."""
    return partitioning.sampled(files.read_any(spark, args.path), args.n, args.seed, args.key)


@command(lambda p: [p.add_argument("folder"), *(p.add_argument(f"--{n}", nargs="+", type=t, required=True) for n, t in (("kinds", str), ("ns", int), ("dims", int), ("ks", int))), p.add_argument("--text", action="store_true"), p.add_argument("--seed", type=int, default=0)])
def generate(spark: SparkSession, args) -> DataFrame:
    """A dataset for every combination of kinds, sizes, dimensions and certificates."""
    return spark.createDataFrame([(x,) for x in generators.generate_all(spark, args.kinds, args.ns, args.dims, args.ks, args.folder, args.text, args.seed)], "path string")


@command(lambda p: p.add_argument("path"))
def metadata(spark: SparkSession, args) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(files.read_metadata(spark, args.path).items())], "key string, value string")


@command(lambda p: (p.add_argument("path"), p.add_argument("--name", required=True)))
def docword(spark: SparkSession, args) -> DataFrame:
    """Bags of a docword file with the words of its vocabulary."""
    bags, words = files.docword_paths(args.path, args.name)
    names = files.read_docword_vocabulary(spark, words)
    cells = files.read_docword(spark, bags).select("doc_id", F.explode("bag").alias("i", "n")).join(names, F.col("i") == F.col("word_id").cast("string"))
    return cells.select("doc_id", "word", "n")


@command(lambda p: (p.add_argument("path"), p.add_argument("--method", choices=["tfidf", "word2vec"], default="tfidf"), p.add_argument("--size", type=int)))
def vectorize(spark: SparkSession, args) -> DataFrame:
    """Vectors of a table with ``doc_id`` and ``text``."""
    docs = files.read_any(spark, args.path)
    if args.method == "word2vec":
        return text.word_vectors(docs.select("doc_id", text.tokens(F.col("text")).alias("words")), "words", args.size or 300)[0].select("doc_id", "vec")
    counts = text.word_counts(docs)
    return text.tf_idf(counts, text.idf(counts, docs.count(), smoothed=True).orderBy(F.desc("total"), "word").limit(args.size or 1 << 18))


@command(lambda p: (p.add_argument("path"), p.add_argument("--metric", choices=sorted(METRICS), default="euclidean")))
def clique(spark: SparkSession, args) -> DataFrame:
    """Objectives of the vectors in a text file, one a line, coordinates joined by commas or spaces."""
    lines = spark.read.text(args.path).filter(F.trim("value") != "")
    return selection.objectives(lines.select(F.monotonically_increasing_id().alias("id"), F.transform(F.split(F.trim("value"), r"[,\s]+"), lambda x: x.cast("double")).alias("vec")), args.metric)


@command(lambda p: (p.add_argument("path"), p.add_argument("--base", default=""), p.add_argument("--least", type=int, default=0), p.add_argument("--categories", help="file of categories, those to leave out marked ^"), p.add_argument("--templates", action="store_true")))
def extract(spark: SparkSession, args) -> DataFrame:
    """Plain text of the articles of a dump."""
    rows = files.read_dump(spark, args.path)
    inside, outside = markup.category_lists([r.value for r in spark.read.text(args.categories).collect()]) if args.categories else (set(), set())
    return markup.extract(rows, markup.collect_templates(rows) if args.templates else None, args.base, args.least, inside, outside)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="dispersa", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (options, f) in COMMANDS.items():
        p = commands.add_parser(name, help=f.__doc__, description=f.__doc__)
        options(p)
        p.add_argument("--out", help="folder of JSON lines; else the console")
        p.add_argument("--rows", type=int, default=50, help="rows on the console")
    args = parser.parse_args(argv)
    _show(COMMANDS[args.command][1](spark or SparkSession.builder.appName("dispersa").getOrCreate(), args), args)


if __name__ == "__main__":
    main(sys.argv[1:])
