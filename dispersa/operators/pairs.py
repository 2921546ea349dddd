"""All pairs of two blocks of rows: matrix products tell which pairs matter, and those are measured by the metric itself.

For the Euclidean metrics a product gives every squared distance but for rounding, of which ``margin`` is a bound. A pair
that this leaves in doubt is measured by the formula of ``distances``, so results are those of the formula. Memory is
that of a tile of products, whatever the number of pairs.
"""

from __future__ import annotations

import numpy as np

from ..functions.metrics import distances

TILE_ROWS, TILE_COLUMNS = 512, 1024
#: Pairs measured by the formula at once.
MEASURED = 1 << 15
SQUARED = {"euclidean": np.sqrt, "sq_euclidean": np.asarray}


class Blocks:
    """Rows ``p`` against rows ``q``, or, where ``q`` is None, each row of ``p`` against those behind it, but for rows of equal ``ids``."""

    def __init__(self, metric: str, p: np.ndarray, q: np.ndarray | None = None, ids: np.ndarray | None = None) -> None:
        self.metric, self.p, self.within = metric, p, q is None
        self.ids = ids if self.within and ids is not None and len(np.unique(ids)) < len(ids) else None
        self.q = p if q is None else q
        np_, nq = (self.p**2).sum(axis=1), (self.q**2).sum(axis=1)
        self.widest = 2 * float(np_.max(initial=0.0) + nq.max(initial=0.0))
        self.margin = 16 * (p.shape[1] + 8) * np.finfo(float).eps * self.widest
        # false for a metric without products, and for numbers that are too large or not numbers
        self.fast = metric in SQUARED and bool(np.isfinite(self.margin))
        if self.fast:
            self.left = np.hstack([-2 * self.p, np_[:, None], np.ones((len(np_), 1))])
            self.right = np.ascontiguousarray(np.hstack([self.q, np.ones((len(nq), 1)), nq[:, None]]).T)

    def tiles(self):
        """``(row, column, squares)`` of each tile, squares of distances within ``margin``; NaN where no pair is meant."""
        for r in range(0, len(self.p), TILE_ROWS):
            for c in range(r // TILE_COLUMNS * TILE_COLUMNS if self.within else 0, len(self.q), TILE_COLUMNS):
                s = self.left[r : r + TILE_ROWS] @ self.right[:, c : c + TILE_COLUMNS]
                if self.within and c < r + len(s):
                    s[np.arange(r, r + len(s))[:, None] >= np.arange(c, c + s.shape[1])[None]] = np.nan
                if self.ids is not None:
                    s[self.ids[r : r + len(s), None] == self.ids[None, c : c + s.shape[1]]] = np.nan
                yield r, c, s

    def _meant(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.within:
            kept = (i < j) if self.ids is None else (i < j) & (self.ids[i] != self.ids[j])
            i, j = i[kept], j[kept]
        return i, j

    def measured(self, i: np.ndarray, j: np.ndarray):
        """``(i, j, distance)`` by the formula, some thousand pairs at a time."""
        i, j = self._meant(i, j)
        for at in range(0, len(i), MEASURED):
            a, b = i[at : at + MEASURED], j[at : at + MEASURED]
            yield a, b, SQUARED[self.metric](((self.q[b] - self.p[a]) ** 2).sum(axis=1))

    def rows(self):
        """``(i, j, distance)`` of all pairs by the formula, a row at a time."""
        for i in range(len(self.p)):
            first = i + 1 if self.within else 0
            if first < len(self.q):
                at, to = self._meant(np.full(len(self.q) - first, i), np.arange(first, len(self.q)))
                yield at, to, distances(self.metric, self.q[to], self.p[i])

    def chosen(self, cut):
        """Measured pairs of which ``cut(squares)`` says, tile by tile, that they may matter; all where there are no products."""
        if not self.fast:
            yield from self.rows()
            return
        for r, c, s in self.tiles():
            at = np.flatnonzero(cut(s))
            yield from self.measured(r + at // s.shape[1], c + at % s.shape[1])


def farthest_pairs(blocks: Blocks, keep: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, distance)`` of the ``keep`` farthest pairs, ties to the least ids; a and b are the ids of either side."""
    best = (np.empty(0, a.dtype), np.empty(0, a.dtype), np.empty(0))

    def cut(s: np.ndarray) -> np.ndarray:
        full = len(best[2]) == keep
        least = (float(best[2][-1]) ** (2 if blocks.metric == "euclidean" else 1)) * (1 - 1e-14) - blocks.margin if full else -np.inf
        maybe = s >= least
        if np.count_nonzero(maybe) > 4 * keep:
            found = s[maybe]
            maybe = s >= max(least, np.partition(found, len(found) - keep)[len(found) - keep] - 2 * blocks.margin)
        return maybe

    for i, j, d in blocks.chosen(cut):
        if len(best[2]) == keep:
            far = d >= best[2][-1]
            i, j, d = i[far], j[far], d[far]
        if len(d):
            x, y = a[i], b[j]
            x, y, d = np.concatenate([best[0], np.minimum(x, y)]), np.concatenate([best[1], np.maximum(x, y)]), np.concatenate([best[2], d])
            order = np.lexsort((y, x, -d))[:keep]
            best = (x[order], y[order], d[order])
    return best


def extent(blocks: Blocks) -> tuple[float, float] | None:
    """The least and the largest distance; None if there is no pair with a distance."""
    lo, hi = np.inf, -np.inf

    def cut(s: np.ndarray) -> np.ndarray:
        if np.isnan(s).all():
            return np.zeros(s.shape, bool)
        power = 2 if blocks.metric == "euclidean" else 1
        near, far = np.nanmin(s) + 2 * blocks.margin, np.nanmax(s) - 2 * blocks.margin
        near = -np.inf if lo == 0 else min(near, lo**power * (1 + 1e-14) + blocks.margin)
        return (s <= near) | (s >= max(far, hi**power * (1 - 1e-14) - blocks.margin if hi >= 0 else -np.inf))

    for _, _, d in blocks.chosen(cut):
        d = d[~np.isnan(d)]
        if len(d):
            lo, hi = min(lo, float(d.min())), max(hi, float(d.max()))
    return (lo, hi) if hi >= lo else None


def counts(blocks: Blocks, lo: float, hi: float, buckets: int) -> np.ndarray:
    """Pairs in each of equally wide buckets from lo to hi, which the last one includes; NaN does not count."""
    out = np.zeros(buckets, np.int64)

    def add(d: np.ndarray) -> None:
        d = d[~np.isnan(d)]
        at = np.minimum(buckets - 1, np.floor((d - lo) / (hi - lo) * buckets)).astype(np.int64) if hi > lo else np.zeros(len(d), np.int64)
        out[:] += np.bincount(at, minlength=buckets)

    if not blocks.fast or blocks.metric != "euclidean" or not hi > lo:
        for _, _, d in blocks.rows():
            add(d)
        return out
    # places of distances above the root of ``low`` are right within ``slack``
    low = max(1e-6 * blocks.widest, 4 * blocks.margin)
    scale = buckets / (hi - lo)
    slack = scale * (blocks.margin / np.sqrt(low) + 1e-13 * (hi + lo)) + 1e-12 * buckets
    for r, c, s in blocks.tiles():
        doubt = ~(s >= low)
        np.fmax(s, low, out=s)
        np.sqrt(s, out=s)
        s -= lo
        s *= scale
        edge = np.rint(s)
        edge -= s
        np.abs(edge, out=edge)
        doubt |= edge <= slack
        at = s.astype(np.int64)
        np.clip(at, 0, buckets - 1, out=at)
        found = np.bincount(at.ravel(), minlength=buckets)
        unsure = np.flatnonzero(doubt)
        if len(unsure):
            found -= np.bincount(at.ravel()[unsure], minlength=buckets)
            for _, _, d in blocks.measured(r + unsure // s.shape[1], c + unsure % s.shape[1]):
                add(d)
        out += found
    return out


def nearest(blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``p`` the place of its nearest row of ``q``, the first of equals, and the distance."""
    at, near = np.zeros(len(blocks.p), np.int64), np.full(len(blocks.p), np.inf)
    if not blocks.fast:
        for i, _, d in blocks.rows():
            at[i[0]], near[i[0]] = d.argmin(), d.min()
        return at, near
    for r, c, s in blocks.tiles():
        best = near[r : r + len(s)]
        best = best**2 if blocks.metric == "euclidean" else best
        maybe = np.flatnonzero(s <= (np.minimum(best * (1 + 1e-14), s.min(axis=1)) + 2 * blocks.margin)[:, None])
        for i, j, d in blocks.measured(r + maybe // s.shape[1], c + maybe % s.shape[1]):
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            i, j, d = i[first], j[first], d[first]
            nearer = d < near[i]
            at[i[nearer]], near[i[nearer]] = j[nearer], d[nearer]
    return at, near
