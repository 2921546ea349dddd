"""Distances, as Column expressions for plans and as numpy kernels for work on whole arrays.

Dense vectors are ``array<double>`` of equal length, bags of words are ``map<string,double>``. Cosines are clamped to
[-1, 1], so angles are never NaN but for zero vectors, whose distance is NaN in SQL and here.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values) -> Column:
    """A vector as an array literal."""
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def sq_euclidean(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sq_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine_similarity(a: Column, b: Column) -> Column:
    return _clamped(dot(a, b), norm(a) * norm(b))


def _clamped(product: Column, lengths: Column) -> Column:
    c = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), product / F.nullif(lengths, F.lit(0.0))))
    return F.when(lengths == 0, F.lit(float("nan"))).otherwise(c)


def cosine_full(a: Column, b: Column) -> Column:
    """The angle over pi: 0 to 1 for any vectors."""
    return F.acos(cosine_similarity(a, b)) / F.pi()


def cosine_half(a: Column, b: Column) -> Column:
    """Twice the angle over pi: 0 to 1 for vectors without negative parts."""
    return 2 * F.acos(cosine_similarity(a, b)) / F.pi()


def cosine_scaled(factor: float) -> Callable[[Column, Column], Column]:
    """The metric of the angle times a factor."""
    return lambda a, b: factor * F.acos(cosine_similarity(a, b))


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "euclidean": euclidean,
    "sq_euclidean": sq_euclidean,
    "manhattan": manhattan,
    "cosine_full": cosine_full,
    "cosine_half": cosine_half,
}


def _bags(a: Column, b: Column, part: Callable[[Column, Column], Column]) -> Column:
    """The sum of ``part`` over the words of either bag, absent ones counting 0; a hash join of two maps."""
    zero = F.lit(0.0)
    return _sum(F.map_values(F.map_zip_with(a, b, lambda _, x, y: part(F.coalesce(x, zero), F.coalesce(y, zero)))))


def bag_euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_bags(a, b, lambda x, y: (x - y) * (x - y)))


def bag_jaccard(a: Column, b: Column) -> Column:
    """1 minus the sum of minima over the sum of maxima; NaN for two empty bags."""
    most = _bags(a, b, F.greatest)
    return F.when(most == 0, F.lit(float("nan"))).otherwise(1 - _bags(a, b, F.least) / F.nullif(most, F.lit(0.0)))


def bag_cosine_similarity(a: Column, b: Column) -> Column:
    lengths = F.sqrt(_sum(F.transform(F.map_values(a), lambda x: x * x))) * F.sqrt(_sum(F.transform(F.map_values(b), lambda x: x * x)))
    return _clamped(_bags(a, b, lambda x, y: x * y), lengths)


def bag_cosine(a: Column, b: Column) -> Column:
    return 2 * F.acos(bag_cosine_similarity(a, b)) / F.pi()


BAG_METRICS = {"euclidean": bag_euclidean, "jaccard": bag_jaccard, "cosine": bag_cosine}


def bag_union(a: Column, b: Column) -> Column:
    return F.array_union(F.map_keys(a), F.map_keys(b))


def bag_intersection(a: Column, b: Column) -> Column:
    return F.array_intersect(F.map_keys(a), F.map_keys(b))


def bag_score(bag: Column, word) -> Column:
    """The score of a word, 0 if it is absent."""
    return F.coalesce(F.try_element_at(bag, F.lit(word)), F.lit(0.0))


def scaled(a: Column, factor) -> Column:
    """Every coordinate divided by ``factor``."""
    return F.transform(a, lambda x: x / factor)


def distances(metric: str, points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """From each row of ``points`` to the vector ``to``."""
    if metric == "euclidean":
        return np.sqrt(((points - to) ** 2).sum(axis=1))
    if metric == "sq_euclidean":
        return ((points - to) ** 2).sum(axis=1)
    if metric == "manhattan":
        return np.abs(points - to).sum(axis=1)
    if metric in ("cosine_full", "cosine_half"):
        with np.errstate(invalid="ignore", divide="ignore"):
            c = np.clip(points @ to / (np.sqrt((points**2).sum(axis=1)) * np.sqrt((to**2).sum())), -1, 1)
        return np.arccos(c) / np.pi * (1 if metric == "cosine_full" else 2)
    raise ValueError(f"no metric {metric}; there are {sorted(METRICS)}")


def matrix(metric: str, points: np.ndarray) -> np.ndarray:
    """All distances of a set of bounded size."""
    return np.array([distances(metric, points, p) for p in points]).reshape(len(points), len(points))
