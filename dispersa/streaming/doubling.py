"""Coresets of streams by the doubling algorithm, as a state machine and as a stateful streaming query.

The state keeps at most tau + 1 centres, each with up to ``delegates`` rows. A row farther than twice the threshold from
every centre becomes one; a full state doubles the threshold and merges centres until tau are left at most.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import distances
from ..operators.frames import ready
from ..operators.matroids import Matroid


class DoublingCoreset:
    """``update`` takes rows one by one; ``kernel`` and ``delegates`` may be read at any time.

    With a matroid, the rows kept for a centre are those of its cluster that independent sets of k rows may need.
    """

    def __init__(self, tau: int, delegates: int = 1, metric: str = "euclidean", matroid: Matroid | None = None, k: int = 0) -> None:
        self.tau, self.limit, self.metric, self.matroid, self.k = tau, delegates, metric, matroid, k
        self.threshold = float("inf")
        self.started = False
        self.restructurings = 0
        self.centres: list[tuple[int, list[float], Any]] = []
        self.kept: list[list[tuple[int, list[float], Any]]] = []

    def _near(self, vec) -> np.ndarray:
        return distances(self.metric, np.array([c[1] for c in self.centres], float), np.asarray(vec, float))

    def _keep(self, at: int, row: tuple) -> bool:
        rows = self.kept[at]
        if self.matroid is None:
            if len(rows) < self.limit:
                rows.append(row)
                return True
            return False
        everyone = [self.centres[at], *rows, row]
        chosen = self.matroid.cluster_points([r[2] for r in everyone], self.k)
        if len(everyone) - 1 in chosen:
            rows.append(row)
            return True
        return False

    def update(self, row_id: int, vec, label: Any = None) -> bool:
        """Whether the row was kept."""
        row = (int(row_id), [float(v) for v in vec], label)
        if not self.centres:
            self.centres.append(row)
            self.kept.append([])
            return True
        if not self.started:
            near = float(self._near(row[1]).min())
            if near == 0 and self.matroid is not None:
                return False
            self.threshold = min(self.threshold, near)
            self.centres.append(row)
            self.kept.append([])
            self.started = len(self.centres) == self.tau + 1
            return True
        self._shrink()
        near = self._near(row[1])
        at = int(np.argmin(near))
        if near[at] > 2 * self.threshold:
            self.centres.append(row)
            self.kept.append([])
            return True
        return self._keep(at, row)

    def _shrink(self) -> None:
        while len(self.centres) > self.tau:
            if self.threshold == 0:
                points = np.array([c[1] for c in self.centres], float)
                gaps = np.concatenate([distances(self.metric, points[i + 1 :], points[i]) for i in range(len(points) - 1)])
                self.threshold = float(gaps[gaps > 0].min()) / 2 if (gaps > 0).any() else 1.0
            else:
                self.threshold *= 2
            self.restructurings += 1
            old = list(zip(self.centres, self.kept, strict=True))
            self.centres, self.kept = [], []
            while old:
                (centre, rows), rest = old[0], old[1:]
                self.centres.append(centre)
                self.kept.append(rows)
                if not rest:
                    break
                gap = distances(self.metric, np.array([c[1] for c, _ in rest], float), np.asarray(centre[1], float))
                for (other, more), g in zip(rest, gap, strict=True):
                    if g <= self.threshold:
                        for row in [other, *more]:
                            self._keep(len(self.centres) - 1, row)
                old = [x for x, g in zip(rest, gap, strict=True) if g > self.threshold]

    def finish(self) -> None:
        """Merges a state of tau + 1 centres, as a read does."""
        if self.started:
            self._shrink()

    def kernel(self) -> list[int]:
        return [c[0] for c in self.centres]

    def delegates(self) -> list[int]:
        return [r[0] for rows in self.kept for r in rows]

    def rows(self) -> Iterator[tuple[str, int, int, list[float]]]:
        for c, rows in zip(self.centres, self.kept, strict=True):
            yield "kernel", c[0], c[0], c[1]
            for r in rows:
                yield "delegate", c[0], r[0], r[1]

    def delegate_radius(self) -> float:
        """The largest distance of a kept row from its centre."""
        return max((float(distances(self.metric, np.array([r[1] for r in rows], float), np.asarray(c[1], float)).max()) for c, rows in zip(self.centres, self.kept, strict=True) if rows), default=0.0)

    def farness(self) -> float:
        """The least distance of two centres."""
        points = np.array([c[1] for c in self.centres], float)
        return min((float(distances(self.metric, points[i + 1 :], points[i]).min()) for i in range(len(points) - 1)), default=float("inf"))

    def dump(self) -> str:
        return json.dumps([self.threshold if np.isfinite(self.threshold) else None, self.started, self.restructurings, self.centres, self.kept])

    def load(self, text: str) -> DoublingCoreset:
        threshold, self.started, self.restructurings, centres, kept = json.loads(text)
        self.threshold = float("inf") if threshold is None else threshold
        self.centres, self.kept = [tuple(c) for c in centres], [[tuple(r) for r in rows] for rows in kept]
        return self


SNAPSHOT = "shard long, version long, role string, center_id long, id long, vec array<double>, threshold double"


def stream_coreset(points: DataFrame, tau: int, delegates: int = 1, metric: str = "euclidean", shards: int = 8, matroid: Matroid | None = None, k: int = 0, label: str | None = None) -> DataFrame:
    """A streaming ``(id, vec)`` to snapshots of its coreset: after each trigger every shard with new rows sends all rows it keeps.

    With a ``matroid`` over the column ``label``, a centre keeps those rows of its cluster that independent sets of k rows may need.

    ``version`` counts a shard's snapshots; the coreset of the stream is the union of the latest of each shard. Rows of a
    trigger are taken by id, so a replay after a failure gives the same state.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        machine, version = DoublingCoreset(tau, delegates, metric, matroid, k), 0
        if state.exists:
            version, held = state.get
            machine.load(held)
        rows = pd.concat(list(frames)).sort_values("id", kind="stable")
        labels = rows["label"] if matroid else [None] * len(rows)
        for i, v, own in zip(rows["id"], rows["vec"], labels, strict=True):
            machine.update(i, v, list(own) if isinstance(own, np.ndarray) else own)
        state.update((version + 1, machine.dump()))
        shown = DoublingCoreset(tau, delegates, metric, matroid, k).load(machine.dump())
        shown.finish()
        kept = list(shown.rows())
        yield pd.DataFrame({"shard": key[0], "version": version + 1, "role": [r[0] for r in kept], "center_id": [r[1] for r in kept], "id": [r[2] for r in kept], "vec": [r[3] for r in kept], "threshold": shown.threshold})

    if (matroid is None) != (label is None):
        raise ValueError("a matroid and its label column come together")
    own = [F.col(label).alias("label")] if label else []
    dealt = ready(points).select("id", "vec", *own, F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInPandasWithState(step, SNAPSHOT, "version long, held string", "append", "NoTimeout")


def latest(snapshots: DataFrame) -> DataFrame:
    """The rows of each shard's last snapshot."""
    last = snapshots.groupBy("shard").agg(F.max("version").alias("version"))
    return snapshots.join(last, ["shard", "version"])


def latency(progress: list[dict]) -> dict[str, float]:
    """Throughput of a streaming query from its progress reports: rows, rows a second, and batch times in milliseconds."""
    times = np.array([p["durationMs"].get("triggerExecution", 0) for p in progress if p["numInputRows"]], float)
    rows = sum(p["numInputRows"] for p in progress)
    if not len(times):
        return {"rows": 0, "rows_per_s": 0.0}
    return {"rows": rows, "rows_per_s": rows / max(times.sum() / 1000, 1e-9), "mean_ms": times.mean(), "stddev_ms": times.std(), "min_ms": times.min(), "max_ms": times.max(), "median_ms": float(np.median(times))}
