"""Where a row of a table of points goes: part numbers as Column expressions, and the repartitions that use them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import norm


def by_hash(parts: int, seed: int = 0) -> Column:
    """A seeded hash of the id: the same row lands in the same part when a task is run again."""
    return F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(parts))


def by_radius(vec: Column, parts: int, largest: float = 1.0) -> Column:
    """Rings of equal width around the origin; ``largest`` 0.8 gives the older variant."""
    return F.floor(norm(vec) / largest * parts)


def by_angle(vec: Column, parts: int) -> Column:
    """Sectors of the plane of the first two coordinates."""
    angle = F.atan2(F.element_at(vec, 2), F.element_at(vec, 1))
    return F.floor(F.when(angle < 0, angle + 2 * F.pi()).otherwise(angle) / (2 * F.pi()) * parts)


def by_grid(vec: Column, cells: int, unit: bool = False) -> Column:
    """The cell of a grid with ``cells`` per dimension over [-1, 1], or [0, 1] if ``unit``; the last cell is closed."""
    place = vec if unit else F.transform(vec, lambda x: (x + 1) / 2)
    return F.aggregate(place, F.lit(0).cast("long"), lambda at, x: at * cells + F.least(F.lit(cells - 1), F.greatest(F.lit(0), F.floor(x * cells))).cast("long"))


def deal(points: DataFrame, part: Column, parts: int) -> DataFrame:
    """``points`` with ``pid``, rows of a part in one partition."""
    return points.withColumn("pid", F.pmod(part.cast("long"), F.lit(parts))).repartition(parts, "pid")


def shuffled(df: DataFrame, seed: int = 0) -> DataFrame:
    """Rows in random order within each partition; no shuffle."""
    return df.sortWithinPartitions(F.xxhash64(F.lit(seed), *df.columns[:1]))


def sampled(df: DataFrame, rows: int, seed: int = 0, key: str = "id") -> DataFrame:
    """About that many rows, each with the same probability by a hash of its key."""
    share = min(1.0, rows / max(1, df.count()))
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(share * (1 << 30)))


def mixed_radix(values: list[Column], base: int) -> Column:
    return reduce(lambda at, v: at * base + v, values)
