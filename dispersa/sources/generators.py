"""Synthetic points with a known certificate: k well-spread points hidden among random ones.

Random columns come from hashes of row number and seed, so a task that runs again makes the same rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import matrix, norm
from ..operators.kernels import OBJECTIVES

_STEPS = 1 << 53


def uniform(seed: int, *key) -> Column:
    """Uniform in (0, 1) by a hash of the key."""
    return (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(_STEPS)) + 0.5) / float(_STEPS)


def gaussian(seed: int, *key) -> Column:
    """Normal by the Box-Muller transform."""
    return F.sqrt(-2 * F.log(uniform(seed, *key))) * F.cos(2 * F.pi() * uniform(seed + 7919, *key))


def _vector(dim: int, part) -> Column:
    return F.array(*[part(F.lit(d)) for d in range(dim)])


def _direction(dim: int, seed: int) -> Column:
    raw = _vector(dim, lambda d: gaussian(seed, "id", d))
    return F.transform(raw, lambda x: x / norm(raw))


def _sphere(dim: int, seed: int, length: Column) -> Column:
    return F.transform(_direction(dim, seed), lambda x: x * length)


KINDS = {
    "uniform-sphere": lambda dim, seed: _sphere(dim, seed, uniform(seed + 1, "id")),
    "uniform-cube": lambda dim, seed: _vector(dim, lambda d: uniform(seed, "id", d)),
    "chasm-sphere": lambda dim, seed: _sphere(dim, seed, 0.8 * uniform(seed + 1, "id")),
    "gaussian-sphere": lambda dim, seed: _sphere(dim, seed, F.least(F.lit(1.0), F.abs(0.25 * gaussian(seed + 1, "id")))),
    "signed-gaussian-sphere": lambda dim, seed: _sphere(dim, seed, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.25 * gaussian(seed + 1, "id")))),
}


def spread_on_sphere(k: int, dim: int, seed: int = 0, tries: int = 1024) -> np.ndarray:
    """k points on the unit sphere, each the farthest from those before among ``tries`` random ones."""
    rng = np.random.default_rng(seed)
    draw = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, dim)))
    out = draw(1)
    while len(out) < k:
        more = draw(tries)
        out = np.vstack((out, more[np.argmax(((more[:, None] - out[None]) ** 2).sum(axis=2).min(axis=1))]))
    return out[:k]


def generate(spark: SparkSession, kind: str, n: int, dim: int, k: int, seed: int = 0) -> DataFrame:
    """``(id, vec, certificate)``: n rows, of which k at random places are the certificate; for the cube it is the first k."""
    if kind not in KINDS:
        raise ValueError(f"no source {kind}; there are {sorted(KINDS)}")
    if kind == "uniform-cube":
        return spark.range(n).select("id", KINDS[kind](dim, seed).alias("vec"), (F.col("id") < k).alias("certificate"))
    places = np.sort(np.random.default_rng(seed).choice(n, k, replace=False))
    known = F.create_map(*[x for i, p in zip(places.tolist(), spread_on_sphere(k, dim, seed), strict=True) for x in (F.lit(i), F.array(*[F.lit(float(v)) for v in p]))]) if k else F.expr("cast(map() AS map<long,array<double>>)")
    given = F.try_element_at(known, F.col("id"))
    return spark.range(n).select("id", F.coalesce(given, KINDS[kind](dim, seed)).alias("vec"), given.isNotNull().alias("certificate"))


def ratios(points: DataFrame, chosen: dict[str, list[int]], metric: str = "euclidean") -> dict[str, float]:
    """Of each objective, the certificate's value over that of the ids chosen."""
    best = np.array([r.vec for r in points.filter("certificate").orderBy("id").select("vec").collect()], float)
    out = {}
    for name, ids in chosen.items():
        own = np.array([r.vec for r in points.filter(F.col("id").isin(ids)).select("vec").collect()], float)
        out[name] = OBJECTIVES[name](matrix(metric, best)) / OBJECTIVES[name](matrix(metric, own))
    return out


def generate_all(spark: SparkSession, kinds: list[str], ns: list[int], dims: list[int], ks: list[int], folder: str, text: bool = False, seed: int = 0) -> list[str]:
    """Writes a dataset for every combination of the parameters; returns their paths."""
    from .files import points_path, write_points, write_points_text

    paths = []
    for kind in kinds:
        for n in ns:
            for dim in dims:
                for k in ks:
                    paths.append(points_path(folder, kind, dim, n, k))
                    data = generate(spark, kind, n, dim, k, seed)
                    if text:
                        write_points_text(data, paths[-1])
                    else:
                        write_points(data, paths[-1], {"data.dimension": dim, "data.num-points": n, "data.k": k, "data.source": kind})
    return paths
