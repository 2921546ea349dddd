"""Selections over whole tables of ``(id, vec)``: farthest points, nearest centres, objectives, samples.

Tables of any size are passed once for each centre; each pass is a projection and one aggregate of a single row.
Anything that looks at all pairs takes a set whose size is checked first: a selection, or a coreset.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.metrics import METRICS, literal, matrix
from . import kernels
from .frames import materialize, ready
from .matroids import Matroid
from .pairs import Blocks, counts, extent, farthest_pairs

#: Rows whose distance matrix one task may hold (128 MB).
MATRIX_ROWS = 4096
#: Rows of a block of which all pairs with another block are one task's work (16 MB of 64 numbers each).
BLOCK_ROWS = 32_768
#: Draws of a random independent set that come to the driver together.
DRAWS = 256
#: Passes between checkpoints of the running distances.
CHECKPOINT_EVERY = 8


class _Traversal:
    """The state of a farthest-point traversal: every row's distance to the centres so far."""

    def __init__(self, points: DataFrame, metric: str, start) -> None:
        self.distance = METRICS[metric]
        first = points.filter(F.col("id") == start).select("id", "vec").head() if start is not None else points.orderBy("id").select("id", "vec").head()
        if first is None and start is not None:
            raise ValueError(f"no row has id {start}")
        self.centres: list[Row] = [first] if first else []
        self.state = points.select("id", "vec")
        if first:
            self.state = self.state.withColumn("md", self.distance(F.col("vec"), literal(first.vec)))

    def farthest(self) -> Row | None:
        """The row farthest from all centres, ties to the least id."""
        return self.state.agg(F.max_by(F.struct("id", "vec", "md"), F.struct("md", -F.col("id"))).alias("far")).head().far

    def add(self, row: Row) -> None:
        self.centres.append(Row(id=row.id, vec=row.vec))
        self.state = self.state.withColumn("md", F.least("md", self.distance(F.col("vec"), literal(row.vec))))
        if len(self.centres) % CHECKPOINT_EVERY == 0:
            self.state = materialize(self.state)


def farthest_points(points: DataFrame, k: int, metric: str = "euclidean", start=None) -> DataFrame:
    """``(step, id, vec, radius)``: k rows, each farthest from those before; radius is how far it was.

    The first one is ``start`` or the least id. Ends early when no row is apart from all chosen; an empty table gives
    no rows. One pass for each step: above a few dozen steps take a coreset first.
    """
    t = _Traversal(points, metric, start)
    rows = [(0, r.id, r.vec, None) for r in t.centres]
    while t.centres and len(t.centres) < k:
        far = t.farthest()
        if not far.md or not far.md > 0:
            break
        rows.append((len(t.centres), far.id, far.vec, far.md))
        t.add(far)
    return points.sparkSession.createDataFrame(rows, "step int, id long, vec array<double>, radius double")


def random_start(points: DataFrame, seed: int = 0):
    """The id of a row drawn by seeded hash, as a start of a traversal; the same for the same rows and seed. None for an empty table."""
    first = points.agg(F.min(F.struct(F.xxhash64(F.lit(seed), "id").alias("h"), "id")).alias("m")).head().m
    return first.id if first else None


def farthest_to_radius(points: DataFrame, radius: float, metric: str = "euclidean", start=None, most: int = 10_000) -> DataFrame:
    """``(id, vec)`` of as few traversal steps as leave every row within ``radius``; ValueError beyond ``most`` of them."""
    t = _Traversal(points, metric, start)
    while t.centres:
        far = t.farthest()
        if not far.md or far.md <= radius:
            break
        if len(t.centres) >= most:
            raise ValueError(f"more than {most} centres are needed")
        t.add(far)
    return points.sparkSession.createDataFrame([(c.id, c.vec) for c in t.centres], "id long, vec array<double>")


def nearest_centre(points: DataFrame, centres: DataFrame, metric: str = "euclidean", most: int = 10_000) -> DataFrame:
    """``points`` with ``center_id`` and ``distance``; ties go to the centre of least id. At most ``most`` centres are
    broadcast, as literals of a plan-independent numpy task."""
    held = centres.select("id", "vec").orderBy("id").limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} centres; assign in rounds")
    spark = ready(points).sparkSession
    shared = spark.sparkContext.broadcast((np.array([c.id for c in held], np.int64), np.array([c.vec for c in held], float)))

    def run(frames):
        from ..functions.metrics import distances

        ids, vecs = shared.value
        for f in frames:
            x = np.array(f["vec"].tolist(), float).reshape(len(f), -1)
            best, at = np.full(len(f), np.inf), np.zeros(len(f), int)
            for k, c in enumerate(vecs):
                d = distances(metric, x, c)
                nearer = d < best
                best[nearer], at[nearer] = d[nearer], k
            yield f.assign(center_id=ids[at] if len(f) else np.empty(0, np.int64), distance=best)

    points = points.drop("center_id", "distance")
    if not held:
        return points.withColumns({"center_id": F.lit(None).cast("long"), "distance": F.lit(None).cast("double")})
    return points.mapInPandas(run, points.withColumns({"center_id": F.lit(0).cast("long"), "distance": F.lit(0.0)}).schema)


def radius(assigned: DataFrame) -> DataFrame:
    """``(center_id, size, radius)`` of each cluster of ``nearest_centre``."""
    return assigned.groupBy("center_id").agg(F.count(F.lit(1)).alias("size"), F.max("distance").alias("radius"))


def pair_distances(points: DataFrame, metric: str = "euclidean", most: int | None = None) -> DataFrame:
    """``(a, b, distance)`` for every a < b of a set of at most ``most`` rows (a selection or a coreset)."""
    most = most or 50_000
    n = points.limit(most + 1).count()
    if n > most:
        raise ValueError(f"pairs of more than {most} rows; take a coreset first")
    a, b = points.select(F.col("id").alias("a"), F.col("vec").alias("va")), points.select(F.col("id").alias("b"), F.col("vec").alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", METRICS[metric](F.col("va"), F.col("vb")).alias("distance"))


def _over_pairs(points: DataFrame, metric: str, most: int | None, block: int | None, work, schema: str) -> DataFrame:
    """``work(blocks, ids of the one side, of the other)`` for each pair of blocks of rows, every one a group of its own.

    Rows are dealt to blocks by hash: a dozen of them, or more for blocks of at most ``BLOCK_ROWS``, which bounds a task.
    """
    n = points.count()
    if most is not None and n > most:
        raise ValueError(f"pairs of more than {most} rows; take a coreset first")
    blocks = max(1, -(-n // (block or min(BLOCK_ROWS, max(256, -(-n // 12))))))
    side = ready(points).select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("x"))
    pairs = side.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("id", "vec", "x", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))

    def run(key, f):
        lo, hi = key
        f = f.sort_values("id", kind="stable")
        p, q = f[f.x == lo], f[f.x == hi]
        ids = p["id"].to_numpy()
        if lo == hi:
            return work(Blocks(metric, _vectors(p), ids=ids), ids, ids)
        if not len(p) or not len(q):
            return work(Blocks(metric, np.empty((0, 1))), ids[:0], ids[:0])
        return work(Blocks(metric, _vectors(p), _vectors(q)), ids, q["id"].to_numpy())

    # a number of partitions that is asked for is not made smaller by the size of the rows, which says nothing of the work
    return pairs.repartition(min(4096, blocks * (blocks + 1) // 2), "lo", "hi").groupBy("lo", "hi").applyInPandas(run, schema)


def _pair_frame(a, b, d) -> pd.DataFrame:
    return pd.DataFrame({"a": a, "b": b, "distance": d})


def pair_blocks(points: DataFrame, metric: str = "euclidean", most: int = 200_000, block: int = 2048) -> DataFrame:
    """Like ``pair_distances``, by numpy blocks."""

    def work(blocks: Blocks, a, b):
        out = [_pair_frame(np.minimum(a[i], b[j]), np.maximum(a[i], b[j]), d) for i, j, d in blocks.rows()]
        return pd.concat(out) if out else _pair_frame(a[:0], b[:0], np.empty(0))

    return _over_pairs(points, metric, most, block, work, "a long, b long, distance double")


def top_pairs(points: DataFrame, k: int, metric: str = "euclidean", most: int | None = None, block: int | None = None) -> DataFrame:
    """``(a, b, distance)`` of the k farthest pairs, ties to the least ids, of a table of any size; only k pairs leave
    each pair of blocks. All pairs are looked at, so time grows with the square of the table."""
    found = _over_pairs(points, metric, most, block, lambda blocks, a, b: _pair_frame(*farthest_pairs(blocks, k, a, b)), "a long, b long, distance double")
    return found.orderBy(F.desc("distance"), "a", "b").limit(k)


def pair_histogram(points: DataFrame, buckets: int = 100, metric: str = "euclidean", most: int | None = None, block: int | None = None) -> DataFrame:
    """``statistics.histogram`` of the distances of all pairs a < b, counted block by block: no pair leaves a task."""

    def ends(blocks: Blocks, a, b):
        found = extent(blocks)
        return pd.DataFrame([found] if found else [], columns=["lo", "hi"], dtype=float)

    e = _over_pairs(points, metric, most, block, ends, "lo double, hi double").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).head()
    if e.lo is None:
        return points.sparkSession.createDataFrame([], "bucket int, left double, n long")

    def count(blocks: Blocks, a, b):
        n = counts(blocks, e.lo, e.hi, buckets)
        return pd.DataFrame({"bucket": np.flatnonzero(n).astype(np.int32), "n": n[n > 0]})

    found = _over_pairs(points, metric, most, block, count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return found.select("bucket", (F.lit(e.lo) + F.lit((e.hi - e.lo) / buckets) * F.col("bucket")).alias("left"), "n")


def objectives(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``(edge, clique, star, mean_pair)`` of a selection, from one relation of its pairs; ``mean_pair`` is the clique over the number of pairs."""
    pairs = pair_distances(points, metric)
    both = pairs.select("a", "distance").unionByName(pairs.select(F.col("b").alias("a"), "distance"))
    star = both.groupBy("a").agg(F.sum("distance").alias("s")).agg(F.min("s").alias("star"))
    return pairs.agg(F.min("distance").alias("edge"), F.sum("distance").alias("clique"), F.avg("distance").alias("mean_pair")).crossJoin(F.broadcast(star)).select("edge", "clique", "star", "mean_pair")


def contribution(points: DataFrame, of, metric: str = "euclidean") -> DataFrame:
    """``(id, total)``: the sum of distances from one row to all others of a table of any size."""
    centre = points.filter(F.col("id") == of).head()
    if centre is None:
        raise ValueError(f"no row has id {of}")
    return points.filter(F.col("id") != of).agg(F.sum(METRICS[metric](F.col("vec"), literal(centre.vec))).alias("total")).select(F.lit(of).cast("long").alias("id"), "total")


def on_one_task(points: DataFrame, work, schema: str, most: int = MATRIX_ROWS) -> DataFrame:
    """Applies ``work(pandas frame ordered by id)`` to a set of at most ``most`` rows, in one executor task."""
    n = points.limit(most + 1).count()
    if n > most:
        raise ValueError(f"{n} rows or more; one task takes {most}: take a coreset first")

    def run(_, f: pd.DataFrame) -> pd.DataFrame:
        return work(f.sort_values("id", kind="stable").reset_index(drop=True))

    return ready(points).withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(lambda key, f: run(key, f.drop(columns="__one")), schema)


def _vectors(f: pd.DataFrame) -> np.ndarray:
    return np.array(f["vec"].tolist(), float).reshape(len(f), -1)


def tree_weight(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``(tree)``: weight of a smallest spanning tree of a selection."""
    return on_one_task(points, lambda f: pd.DataFrame({"tree": [kernels.tree(matrix(metric, _vectors(f)))]}), "tree double")


def matched(points: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """``(rank, id)`` of the greedy matching of a coreset."""

    def work(f):
        got = kernels.heaviest_pairs(matrix(metric, _vectors(f)), k)
        return pd.DataFrame({"rank": np.arange(len(got), dtype=np.int32), "id": f["id"].to_numpy()[got]})

    return on_one_task(points, work, "rank int, id long")


def local_search(points: DataFrame, k: int, metric: str = "euclidean", gain: float = 0.0, objective: str = "clique", matroid: Matroid | None = None, label: str | None = None) -> DataFrame:
    """``(id, value)``: a locally best selection of a coreset, and its objective."""

    def work(f):
        d = matrix(metric, _vectors(f))
        got = kernels.swap_search(d, k, gain, objective, matroid, None if label is None else [x if not isinstance(x, np.ndarray) else list(x) for x in f[label]])
        return pd.DataFrame({"id": f["id"].to_numpy()[got], "value": kernels.OBJECTIVES[objective](d[np.ix_(got, got)])})

    return on_one_task(points, work, "id long, value double")


def approximate(points: DataFrame, k: int, metric: str = "euclidean", runs: int = 1, use_matching: bool = True) -> DataFrame:
    """``(objective, value, ids)`` of the best selection found for each objective on a coreset."""

    def work(f):
        got = kernels.approximate(_vectors(f), k, metric, runs, use_matching)
        return pd.DataFrame([(o, v, f["id"].to_numpy()[c].tolist()) for o, (c, v) in sorted(got.items())], columns=["objective", "value", "ids"])

    return on_one_task(points, work, "objective string, value double, ids array<long>")


def random_rows(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k rows drawn without replacement: those of least seeded hash, so a rerun draws the same."""
    return points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k)


def bernoulli_rows(points: DataFrame, k: int, share: float, seed: int = 0) -> DataFrame:
    """k rows of a sample of each row with probability ``share``; ValueError if the sample has fewer."""
    drawn = points.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id").limit(k)
    if drawn.count() < k:
        raise ValueError(f"the sample has fewer than {k} rows")
    return drawn


def random_independent(points: DataFrame, k: int, matroid: Matroid, label: str, seed: int = 0, tries: int = 10_000) -> tuple[DataFrame, int]:
    """k random rows that are independent, and how many draws that took."""
    at = 0
    while at < tries:
        # one sort gives many draws: consecutive runs of k rows in an order by seeded hash
        pool = random_rows(points.select("id", label), k * min(DRAWS, tries - at), seed + at).collect()
        draws = [pool[i : i + k] for i in range(0, len(pool) - k + 1, k)] or [pool]
        for t, rows in enumerate(draws):
            if len(rows) == k and matroid.independent([r[label] for r in rows]):
                return points.filter(F.col("id").isin([r.id for r in rows])), at + t + 1
        at += len(draws)
    raise ValueError(f"no independent set in {tries} draws")


def sampled_diversity(points: DataFrame, k: int, samples: int, metric: str, matroid: Matroid, label: str, rows: int = 200, seed: int = 0) -> DataFrame:
    """``(sample, size, clique, mean_pair)``: for each random sample of ``rows`` rows the clique of its first k independent ones."""
    drawn = None
    for s in range(samples):
        part = random_rows(points.select("id", "vec", label), rows, seed + s).withColumn("sample", F.lit(s))
        drawn = part if drawn is None else drawn.unionByName(part)

    def work(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        got = matroid.greedy([list(x) if isinstance(x, np.ndarray) else x for x in f[label]], k)
        value = kernels.clique(matrix(metric, _vectors(f)[got]))
        n = len(got)
        return pd.DataFrame({"sample": [int(f["sample"].iloc[0])], "size": [n], "clique": [value], "mean_pair": [value / (n * (n - 1) / 2) if n > 1 else float("nan")]})

    return ready(drawn).groupBy("sample").applyInPandas(work, "sample int, size int, clique double, mean_pair double")


def diameter(points: DataFrame, metric: str = "euclidean", matroid: Matroid | None = None, label: str | None = None) -> DataFrame:
    """``(a, b, distance)``: the farthest pair of a coreset, or the farthest independent one at either of its ends."""

    def work(f):
        labels = None if label is None else [list(x) if isinstance(x, np.ndarray) else x for x in f[label]]
        i, j, v = kernels.diameter(matrix(metric, _vectors(f)), matroid, labels)
        return pd.DataFrame({"a": [f["id"].iloc[i]], "b": [f["id"].iloc[j]], "distance": [v]})

    return on_one_task(points, work, "a long, b long, distance double")


def within(points: DataFrame, of, radius: float, distance) -> DataFrame:
    """Rows strictly nearer than ``radius`` to the row ``of`` by ``distance(row columns, centre row)``; ValueError without such a row."""
    centre = points.filter(F.col("id") == of).head()
    if centre is None:
        raise ValueError(f"no row has id {of}")
    return points.withColumn("distance", distance(centre)).filter(F.col("distance") < radius)
