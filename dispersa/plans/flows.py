"""Whole flows from a table of points to a selection and its report."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coresets, selection
from ..operators.frames import materialize
from ..operators.matroids import Matroid


@dataclass
class Outcome:
    solution: DataFrame
    coreset: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)


def _timed(seconds: dict[str, float], name: str, make):
    began = time.monotonic()
    out = make()
    seconds[name] = time.monotonic() - began
    return out


def map_reduce(points: DataFrame, k: int, tau: int, matroid: Matroid | None = None, label: str | None = None, metric: str = "euclidean", parts: int | None = None, sparse_tau: int | None = None, gain: float = 0.0) -> Outcome:
    """Coresets of parts, their union (made sparse by a second round if ``sparse_tau`` is given), local search on it.

    The solution is ``(id, value)`` with k rows, fewer if there are no k independent ones.
    """
    seconds: dict[str, float] = {}
    pid = None if parts is None else F.pmod("id", F.lit(parts))

    def build(rows: DataFrame, size: int, part) -> DataFrame:
        if matroid is None:
            return coresets.coreset(rows, size, k, metric, part)
        return coresets.matroid_coreset(rows, k, matroid, label, tau=size, metric=metric, pid=part)

    columns = ["id", "vec"] + ([label] if label else [])
    core = _timed(seconds, "coreset", lambda: materialize(build(points, tau, pid).select(*columns)))
    if sparse_tau is not None:
        core = _timed(seconds, "sparse", lambda: materialize(build(core, sparse_tau, F.lit(0)).select(*columns)))
    found = _timed(seconds, "search", lambda: materialize(selection.local_search(core, k, metric, gain, "clique", matroid, label)))
    return Outcome(found, core, seconds)


def sequential(points: DataFrame, k: int, metric: str = "euclidean", matroid: Matroid | None = None, label: str | None = None, gain: float = 0.0) -> Outcome:
    """Local search on a table that one task can take: its own coreset."""
    columns = ["id", "vec"] + ([label] if label else [])
    seconds: dict[str, float] = {}
    found = _timed(seconds, "search", lambda: materialize(selection.local_search(points.select(*columns), k, metric, gain, "clique", matroid, label)))
    return Outcome(found, points.select(*columns), seconds)


def random_choice(points: DataFrame, k: int, seed: int = 0) -> Outcome:
    return Outcome(selection.random_rows(points, k, seed).select("id", "vec"), points)


def report(outcome: Outcome, points: DataFrame, metric: str = "euclidean", tags: dict | None = None) -> dict[str, DataFrame]:
    """Tables ``solution``, ``value`` and ``times`` of an outcome."""
    spark = points.sparkSession
    chosen = points.join(outcome.solution.select("id"), "id", "left_semi")
    return {
        "solution": chosen,
        "value": selection.objectives(chosen.select("id", "vec"), metric),
        "times": spark.createDataFrame([(n, float(s)) for n, s in outcome.seconds.items()], "component string, seconds double"),
    }
