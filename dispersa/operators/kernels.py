"""Selections on arrays of bounded size: what runs within one task, on a partition or on a coreset.

Rows are numbered in input order, and every tie goes to the lower number.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np

from ..functions.metrics import distances, matrix  # noqa: F401
from . import pairs
from .matroids import Matroid


def farthest(points: np.ndarray, k: int, metric: str = "euclidean", start: int = 0) -> tuple[list[int], list[float], np.ndarray, np.ndarray]:
    """Farthest-point traversal: the rows chosen, the radius before each choice, and for each row its nearest chosen
    one (by place in the choice, the first of equals) and the distance. Stops early when no row is apart from all chosen."""
    if not 0 <= start < max(1, len(points)):
        raise ValueError("no such start")
    if not len(points):
        return [], [], np.empty(0, int), np.empty(0)
    chosen, radii = [start], []
    near = distances(metric, points, points[start])
    nearest = np.zeros(len(points), int)
    while len(chosen) < min(k, len(points)):
        far = int(np.argmax(near))
        if not near[far] > 0:
            break
        radii.append(float(near[far]))
        d = distances(metric, points, points[far])
        nearer = d < near
        near, nearest[nearer] = np.where(nearer, d, near), len(chosen)
        chosen.append(far)
    return chosen, radii, nearest, near


def farthest_to_radius(points: np.ndarray, radius: float, metric: str = "euclidean", start: int = 0, pool: int = 1024) -> list[int]:
    """As few steps of the traversal as leave every row within ``radius`` of a chosen one; in input order.

    Rows within the radius leave the search. The ``pool`` farthest rows are kept up to date at every step; the others,
    whose distances only fall, after the steps that leave none in the pool farther than they were.
    """
    if not len(points):
        return []
    chosen, near = [start], distances(metric, points, points[start])
    at = np.flatnonzero(near > radius)
    near, x = near[at], points[at]
    while len(at):
        ranked = np.lexsort((np.arange(len(at)), -near))
        inside = np.sort(ranked[:pool])
        first, nearby, some = len(chosen), near[inside], x[inside]
        # what the next row must surpass; the first one of a pool does
        most, place = (near[ranked[pool]], ranked[pool]) if len(at) > pool else (-np.inf, 0)
        while True:
            i = int(np.argmax(nearby))
            if not nearby[i] > radius or nearby[i] < most or (nearby[i] == most and inside[i] > place):
                break
            chosen.append(int(at[inside[i]]))
            nearby = np.minimum(nearby, distances(metric, some, some[i]))
        _, d = pairs.nearest(pairs.Blocks(metric, x, points[chosen[first:]]))
        near = np.minimum(near, d)
        left = near > radius
        at, near, x = at[left], near[left], x[left]
    return sorted(chosen)


def heaviest_pairs(d: np.ndarray, k: int) -> list[int]:
    """Greedy matching: the heaviest pair of unused rows, k // 2 times; an odd k adds the first unused row."""
    n = len(d)
    if n <= k:
        return list(range(n))
    i, j = np.triu_indices(n, 1)
    order = np.lexsort((j, i, -d[i, j]))
    used, out = np.zeros(n, bool), []
    for p in order:
        if len(out) >= k - k % 2:
            break
        if not used[i[p]] and not used[j[p]]:
            used[[i[p], j[p]]] = True
            out += [int(i[p]), int(j[p])]
    if k % 2:
        out.append(int(np.flatnonzero(~used)[0]))
    return out


def edge(d: np.ndarray) -> float:
    return float(d[np.triu_indices(len(d), 1)].min()) if len(d) > 1 else float("nan")


def clique(d: np.ndarray) -> float:
    return float(d[np.triu_indices(len(d), 1)].sum())


def star(d: np.ndarray) -> float:
    return float(d.sum(axis=1).min()) if len(d) else float("nan")


def tree(d: np.ndarray) -> float:
    """Weight of a smallest spanning tree, by Prim's algorithm on a heap."""
    n, total, seen = len(d), 0.0, set()
    heap = [(0.0, 0)] if n else []
    while len(seen) < n:
        w, x = heapq.heappop(heap)
        if x in seen:
            continue
        seen.add(x)
        total += w
        for y in range(n):
            if y not in seen:
                heapq.heappush(heap, (float(d[x, y]), y))
    return total


OBJECTIVES: dict[str, Callable[[np.ndarray], float]] = {"edge": edge, "clique": clique, "star": star, "tree": tree}


def initial_set(d: np.ndarray, k: int) -> list[int]:
    """The farthest pair, then the first others."""
    if len(d) <= k or k < 2:
        return list(range(min(k, len(d))))
    i, j = np.unravel_index(int(np.argmax(np.triu(d, 1))), d.shape)
    pair = [int(i), int(j)]
    return pair + [x for x in range(len(d)) if x not in pair][: k - 2]


def swap_search(d: np.ndarray, k: int, gain: float = 0.0, objective: str | Callable[[np.ndarray], float] = "clique", matroid: Matroid | None = None, labels: Sequence[Any] | None = None) -> list[int]:
    """Local search: swaps a chosen row for another as long as that raises the objective by a factor over 1 + gain.

    Without a constraint it starts at the farthest pair, else at the first independent rows; every set on the way is
    independent. For the clique objective each row's distance to the set is kept up to date, so a scan is one vector step.
    """
    n = len(d)
    chosen = matroid.greedy(labels, k) if matroid else initial_set(d, k)
    if len(chosen) < 2 or len(chosen) == n:
        return sorted(chosen)
    score = OBJECTIVES[objective] if isinstance(objective, str) else objective
    inside = np.zeros(n, bool)
    inside[chosen] = True
    fast = objective == "clique"
    toward = d[:, inside].sum(axis=1)
    value = score(d[np.ix_(inside, inside)])

    def swap() -> bool:
        nonlocal value, toward
        for i in np.flatnonzero(inside).tolist():
            if fast:
                after = value - toward[i] + toward - d[:, i]
                tried = np.flatnonzero(~inside & (after > (1 + gain) * value * (1 + 1e-12))).tolist()
            else:
                tried = np.flatnonzero(~inside).tolist()
            for j in tried:
                rest = inside.copy()
                rest[i], rest[j] = False, True
                new = float(after[j]) if fast else score(d[np.ix_(rest, rest)])
                if new > (1 + gain) * value * (1 + 1e-12) and (matroid is None or matroid.independent([labels[x] for x in np.flatnonzero(rest)])):
                    inside[i], inside[j] = False, True
                    toward = toward - d[:, i] + d[:, j]
                    value = new
                    return True
        return False

    while swap():
        pass
    return np.flatnonzero(inside).tolist()


def clique_search(points: np.ndarray, k: int, metric: str = "euclidean", gain: float = 0.0) -> list[int]:
    """``swap_search`` for the clique objective without a constraint and without a matrix: only the distances to chosen
    rows are held, so memory grows with the rows and not with their square."""
    n = len(points)
    if n <= k or k < 2:
        return list(range(min(k, n)))
    i, j, _ = pairs.farthest_pairs(pairs.Blocks(metric, points), 1, np.arange(n), np.arange(n))
    pair = [int(i[0]), int(j[0])] if len(i) else [0, 1]
    chosen = sorted(pair + [x for x in range(k + 1) if x not in pair][: k - 2])
    to = {c: distances(metric, points, points[c]) for c in chosen}
    inside = np.zeros(n, bool)
    inside[chosen] = True
    toward = np.stack([to[c] for c in chosen], axis=1).sum(axis=1)
    value = clique(np.array([[to[c][r] for c in chosen] for r in chosen]))

    def swap() -> bool:
        nonlocal value, toward
        for i in np.flatnonzero(inside).tolist():
            after = value - toward[i] + toward - to[i]
            better = ~inside & (after > (1 + gain) * value * (1 + 1e-12))
            if better.any():
                j = int(np.argmax(better))
                inside[i], inside[j] = False, True
                to[j] = distances(metric, points, points[j])
                toward = toward - to.pop(i) + to[j]
                value = float(after[j])
                return True
        return False

    while swap():
        pass
    return np.flatnonzero(inside).tolist()


def best_start(points: np.ndarray, k: int, runs: int, metric: str, objective: str) -> tuple[list[int], float]:
    """The best of ``runs`` farthest-point traversals from the first rows."""
    found = []
    for s in range(min(runs, len(points))):
        chosen = farthest(points, k, metric, s)[0]
        found.append((OBJECTIVES[objective](matrix(metric, points[chosen])), -s, chosen))
    value, _, chosen = max(found)
    return chosen, value


def approximate(points: np.ndarray, k: int, metric: str = "euclidean", runs: int = 1, use_matching: bool = True) -> dict[str, tuple[list[int], float]]:
    """A selection and its value for each objective: traversals for edge and tree, for clique and star the matching or
    the better of the others' sets."""
    out = {o: best_start(points, k, runs, metric, o) for o in ("edge", "tree")}
    pools = [out["edge"][0], out["tree"][0]]
    if use_matching:
        pools.insert(0, heaviest_pairs(matrix(metric, points), k))
    for o in ("clique", "star"):
        values = [OBJECTIVES[o](matrix(metric, points[p])) for p in pools]
        best = int(np.argmax(values))
        out[o] = (pools[best], values[best])
    return out


def diameter(d: np.ndarray, matroid: Matroid | None = None, labels: Sequence[Any] | None = None) -> tuple[int, int, float]:
    """The farthest pair; where it is dependent, the farthest independent pair that has one of its ends."""
    i, j = map(int, np.unravel_index(int(np.argmax(np.triu(d, 1))), d.shape))
    if matroid is None or matroid.independent([labels[i], labels[j]]):
        return i, j, float(d[i, j])
    pairs = [(float(d[e, x]), -min(e, x), -max(e, x)) for e in (i, j) for x in range(len(d)) if x != e and matroid.independent([labels[e], labels[x]])]
    if not pairs:
        raise ValueError("no end of the farthest pair has an independent partner")
    v, a, b = max(pairs)
    return -a, -b, v
