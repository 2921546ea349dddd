"""Coresets: small subsets that stand for a table when diverse rows are sought, built part by part and merged.

Each part of ``(id, vec[, label])`` is at most ``rows_per_part`` rows, so a task's memory does not depend on the table.
Coresets of parts compose by union; rounds go on until one task can take what is left.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels, pairs
from .frames import ready
from .matroids import Matroid, Partition, Uniform

ROWS_PER_PART = 100_000
SCHEMA = "pid long, role string, center_id long, id long, vec array<double>, radius double"


def _labels(f: pd.DataFrame, label: str | None) -> list | None:
    return None if label is None else [list(x) if isinstance(x, np.ndarray) else x for x in f[label]]


def _build(f: pd.DataFrame, pick: Callable, metric: str, tau: int | None, to_radius: float | None, label: str | None) -> pd.DataFrame:
    f = f.sort_values("id", kind="stable").reset_index(drop=True)
    x = np.array(f["vec"].tolist(), float).reshape(len(f), -1)
    if to_radius is not None:
        chosen = kernels.farthest_to_radius(x, to_radius, metric)
        nearest, near = np.zeros(len(x), np.int64), np.zeros(len(x))
        others = np.setdiff1d(np.arange(len(x)), chosen)
        nearest[others], near[others] = pairs.nearest(pairs.Blocks(metric, x[others], x[chosen]))
    elif len(f) < tau:
        chosen, nearest, near = list(range(len(f))), np.arange(len(f)), np.zeros(len(f))
    else:
        chosen, _, nearest, near = kernels.farthest(x, tau, metric)
    nearest = nearest.copy()
    nearest[chosen] = np.arange(len(chosen))
    labels = _labels(f, label)
    rows = []
    by_centre = np.argsort(nearest, kind="stable")
    for centre, members in zip(chosen, np.split(by_centre, np.searchsorted(nearest[by_centre], np.arange(1, len(chosen)))), strict=True):
        rows += [("kernel", centre, centre)] + [("delegate", centre, m) for m in pick(members, centre, near, labels) if m != centre]
    at = [r[2] for r in rows]
    ids = f["id"].to_numpy()
    out = pd.DataFrame({"pid": f["pid"].to_numpy()[at], "role": [r[0] for r in rows], "center_id": ids[[r[1] for r in rows]], "id": ids[at], "vec": [f["vec"].iloc[a] for a in at], "radius": float(near.max()) if len(near) else 0.0})
    return out if label is None else out.assign(**{label: [f[label].iloc[a] for a in at]})


def _schema(points: DataFrame, label: str | None) -> str:
    return SCHEMA if label is None else f"{SCHEMA}, {label} {points.schema[label].dataType.simpleString()}"


def parts(points: DataFrame, rows_per_part: int = ROWS_PER_PART) -> Column:
    """A part number by hash of the id, for parts of about that many rows."""
    return F.pmod(F.xxhash64("id"), F.lit(max(1, -(-points.count() // rows_per_part))))


def coreset(points: DataFrame, tau: int, delegates: int = 1, metric: str = "euclidean", pid: Column | None = None) -> DataFrame:
    """``(pid, role, center_id, id, vec, radius)``: in each part ``tau`` farthest points, and for each of them up to
    ``delegates - 1`` rows of its cluster at a distance above 0, least ids first. A part under ``tau`` rows is kept whole."""

    def pick(members, centre, near, _):
        return members[near[members] > 0][: delegates - 1].tolist()

    part = points.select("id", "vec", (parts(points) if pid is None else pid).cast("long").alias("pid"))
    return ready(part).groupBy("pid").applyInPandas(lambda f: _build(f, pick, metric, tau, None, None), SCHEMA)


def matroid_coreset(points: DataFrame, k: int, matroid: Matroid, label: str, tau: int | None = None, to_radius: float | None = None, metric: str = "euclidean", pid: Column | None = None) -> DataFrame:
    """As ``coreset``, with those rows of each cluster that an independent set of k rows may need; centres come by
    number (``tau``) or until every row lies within ``to_radius``."""
    if (tau is None) == (to_radius is None):
        raise ValueError("give tau or to_radius")

    def pick(members, centre, near, labels):
        return [int(members[i]) for i in matroid.cluster_points([labels[m] for m in members], k)]

    part = points.select("id", "vec", label, (parts(points) if pid is None else pid).cast("long").alias("pid"))
    return ready(part).groupBy("pid").applyInPandas(lambda f: _build(f, pick, metric, tau, to_radius, label), _schema(points, label))


def local_search_coreset(points: DataFrame, k: int, metric: str = "euclidean", gain: float = 0.0, pid: Column | None = None, rows_per_part: int = 2000) -> DataFrame:
    """``(pid, id, vec)``: a locally best clique of k rows of each part."""

    def work(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", kind="stable").reset_index(drop=True)
        return f.iloc[kernels.clique_search(np.array(f["vec"].tolist(), float), k, metric, gain)]

    part = points.select((parts(points, rows_per_part) if pid is None else pid).cast("long").alias("pid"), "id", "vec")
    return ready(part).groupBy("pid").applyInPandas(work, "pid long, id long, vec array<double>")


def merge(*coresets: DataFrame) -> DataFrame:
    """The union of coresets with the largest radius, each id once; a kernel row wins over a delegate."""
    both = coresets[0]
    for c in coresets[1:]:
        both = both.unionByName(c)
    widest = both.agg(F.max("radius").alias("radius"))
    first = Window.partitionBy("id").orderBy(F.col("role").desc(), "pid", "center_id")
    return both.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r", "radius").crossJoin(F.broadcast(widest))


def shrink(points: DataFrame, tau: int, delegates: int = 1, metric: str = "euclidean", most: int = 4096, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``(id, vec)`` of at most ``most`` rows: rounds of coresets of parts, for as long as a round makes the table smaller."""
    from .frames import materialize

    left, n = points.select("id", "vec"), points.count()
    while n > most:
        pid = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // rows_per_part))))
        left = materialize(coreset(left, tau, delegates, metric, pid).select("id", "vec"))
        before, n = n, left.count()
        if n >= before:
            raise ValueError("tau and delegates keep every row; take fewer")
    return left


def delegates_in_sql(assigned: DataFrame, m: int) -> DataFrame:
    """Of rows ``(id, center_id, distance)`` the first m - 1 of each cluster apart from its centre: the window form of ``coreset``."""
    rank = F.row_number().over(Window.partitionBy("center_id").orderBy("id"))
    return assigned.filter("distance > 0").withColumn("r", rank).filter(F.col("r") <= m - 1).drop("r")


def greedy_in_sql(rows: DataFrame, k: int, matroid: Uniform | Partition, label: str = "label", by: str | None = None) -> DataFrame:
    """The first k independent rows by id, in each group of ``by``: equal to a scan, for the greedy choice within one
    category does not depend on the others until the k-th row."""
    group = [by] if by else []
    if isinstance(matroid, Uniform):
        kept = rows
        k = min(k, matroid.cardinality)
    else:
        caps = F.create_map(*[x for c, n in matroid.caps.items() for x in (F.lit(c), F.lit(n))]) if matroid.caps else F.expr("map()")
        within = Window.partitionBy(*group, label).orderBy("id")
        kept = rows.withColumn("__c", F.row_number().over(within)).filter(F.col("__c") <= F.coalesce(F.try_element_at(caps, F.col(label)), F.lit(0))).drop("__c")
    if not by:
        return kept.orderBy("id").limit(k)
    return kept.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy("id"))).filter(F.col("__k") <= k).drop("__k")
