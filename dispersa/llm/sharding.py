"""Sharding by balanced label propagation, in DataFrame operations alone.

Documents begin in shards by a hash of what they are. In each round every linked document counts, over the groups it
belongs to, how many members each shard holds, and wants to be where most are, less so the fuller that shard is. Moves
between two shards happen as far as they are matched by moves the other way or by room left for linked documents,
chosen by group, so that a group moves as one. Rounds go on until one saves no more cuts. A group of more rows than a
shard takes is dealt over as few shards as hold it and stays there. At the end every shard is cut to its quota: a shard
gives up documents without links first, and what it gives up fills the shards that lack some. Row counts then differ by
one at most.

A group is a hyperedge: its members vote through one row of counts, so a group of n rows costs n rows and not n squared.
Nothing depends on how rows lie in files: equal rows are told apart by number, and all choices are by hashes of values.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, join_unique

SHARDS = 24
ROUNDS = 12
BUCKET_ROWS = 2000
REPEATS = 100_000


def _array(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _at(values: Column, index: Column) -> Column:
    return F.element_at(values, index.cast("int") + 1)


def _counts(labels: DataFrame, shards: int) -> list[int]:
    """Rows of each shard: one row a shard comes to the driver."""
    found = {r["shard"]: r["count"] for r in labels.groupBy("shard").count().collect()}
    return [found.get(s, 0) for s in range(shards)]


def _shares(demand: dict[tuple[int, int], int], sizes: list[int], room: int) -> list[int]:
    """In millionths, how many of the moves from shard i to j may happen, at i * shards + j."""
    shards = len(sizes)
    out = [0] * (shards * shards)
    for j in range(shards):
        left = max(0, room - sizes[j])
        inward = {i: demand.get((i, j), 0) for i in range(shards)}
        matched = {i: min(n, demand.get((j, i), 0)) for i, n in inward.items()}
        rest = sum(inward.values()) - sum(matched.values())
        for i, n in inward.items():
            if n:
                extra = (n - matched[i]) * min(1.0, left / rest) if rest else 0
                out[i * shards + j] = int(1e6 * (matched[i] + extra) / n)
    return out


def propagate(linked: DataFrame, labels: DataFrame, shards: int, rounds: int, scratch: Scratch) -> DataFrame:
    """``(rid, shard)`` after some rounds from ``labels(rid, shard)``; ``linked(rid, g, n)``, a written table, says which
    rows belong to which groups and of how many rows.

    Rows of no group keep their shard, and so do those of groups of more rows than a shard's quota alone.
    """
    room = max(1, labels.count() // shards)
    groups = linked.filter((F.col("n") > 1) & (F.col("n") <= room))
    if groups.isEmpty():
        return labels.select("rid", "shard")
    ids = groups.select("rid").distinct()
    fixed = scratch.table(labels.select("rid", "shard").join(ids, "rid", "left_anti"), "fixed")
    moving = scratch.table(labels.select("rid", "shard").join(ids, "rid", "left_semi"), "moving")
    base = _counts(fixed.join(linked.filter(F.col("n") > room).select("rid").distinct(), "rid", "left_semi"), shards)
    columns = [f"c{s}" for s in range(shards)]
    best, cuts, wishes = moving, None, []
    for turn in range(rounds + 1):
        cells = scratch.table(groups.join(moving, "rid"), "cells")
        votes = scratch.table(cells.groupBy("g").agg(F.first("n").alias("n"), *[F.sum((F.col("shard") == s).cast("long")).alias(c) for s, c in enumerate(columns)]), "votes")
        now = votes.agg(F.sum(sum((F.col(c) > 0).cast("long") for c in columns) - 1)).head()[0]
        if cuts is not None and now >= cuts:
            break
        best, cuts = moving, now
        if not cuts or turn == rounds:
            break
        held = [a + b for a, b in zip(base, _counts(moving, shards), strict=True)]
        told = join_unique(cells.drop("n"), votes, ["g"], "n", scratch).groupBy("rid").agg(F.first("shard").alias("shard"), F.min("g").alias("anchor"), F.max("n").alias("n"), *[F.sum(c).alias(c) for c in columns])
        # the count of members, less for a fuller shard, and ties by a hash that all members of a group share
        scores = F.array(*[F.col(c) * F.lit(max(0.05, 1 - 0.5 * max(0.0, held[s] / room - 0.5))) + (F.col(c) > 0).cast("int") * F.pmod(F.xxhash64("anchor", F.lit(s), F.lit(turn)), F.lit(1000)) / 4000 for s, c in enumerate(columns)])
        wish = told.select("rid", "shard", "anchor", "n", scores.alias("scores")).select("rid", "shard", "anchor", "n", (F.array_position("scores", F.array_max("scores")) - 1).cast("int").alias("target"))
        wish = scratch.table(wish, "wish")
        demand = {(r["shard"], r["target"]): r["count"] for r in wish.filter("shard <> target").groupBy("shard", "target").count().collect()}
        if not demand:
            break
        share = _at(_array(_shares(demand, held, room)), F.col("shard") * shards + F.col("target"))
        # a group moves as one and draws the lower lots, unless it is large for the room of a shard
        large = F.col("n") * 4 > room
        lot = F.pmod(F.xxhash64("anchor", F.lit(turn)), F.lit(500_000)) + F.when(large, 500_000).otherwise(0)
        goes = (F.col("shard") != F.col("target")) & (lot < share)
        moving = wish.select("rid", F.when(goes, F.col("target")).otherwise(F.col("shard")).alias("shard"))
        wishes.append(wish)
        for old in (cells, votes, *wishes[:-2]):  # the best labels may rest on the wishes of the round before
            scratch.drop(old)
        del wishes[:-2]
    return fixed.unionByName(best)


def balance_rows(rows: DataFrame, shards: int, scratch: Scratch, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows(own, shard, linked, g, n, doc_id, size, text_crc32, k)`` with final ``shard`` and ``slot``: counts at most one apart, slots gapless from 0.

    Places within a shard come from counts of buckets of about ``bucket_rows`` rows and a window within each bucket, so
    no task holds a whole shard. Linked rows come first, group by group; a group above that size is dealt over buckets.
    """
    sizes = _counts(rows, shards)
    total = sum(sizes)
    quota = [total // shards] * shards
    for s in sorted(range(shards), key=lambda s: (-sizes[s], s))[: total % shards]:
        quota[s] += 1
    buckets = max(1, total // (shards * bucket_rows))
    group = F.pmod(F.xxhash64("g"), F.lit(buckets))
    spread = F.pmod(F.xxhash64("own"), F.lit(buckets))
    bucket = F.when(~F.col("linked"), spread).when(F.col("n") > bucket_rows, F.pmod(group + F.pmod(spread, F.ceil(F.col("n") / (bucket_rows * shards)) + 1), F.lit(buckets))).otherwise(group)
    dealt = rows.withColumn("bucket", F.when(F.col("linked"), bucket).otherwise(bucket + buckets).cast("long"))
    part = Window.partitionBy("shard", "bucket").orderBy("g", "doc_id", "size", "text_crc32", "k")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    placed = dealt.withColumn("k", F.row_number().over(part)).join(starts, ["shard", "bucket"]).withColumn("place", F.col("start") + F.col("k") - 1)
    over = [max(0, n - q) for n, q in zip(sizes, quota, strict=True)]
    lack = [max(0, q - n) for n, q in zip(sizes, quota, strict=True)]
    first_over, first_lack = [0, *accumulate(over)], [0, *accumulate(lack)]
    stays = F.col("place") < _at(_array(quota), F.col("shard"))
    number = _at(_array(first_over), F.col("shard")) + F.col("place") - _at(_array(quota), F.col("shard"))
    goal = F.size(F.filter(_array(first_lack[1:]), lambda x: x <= F.col("number")))
    moved = placed.withColumn("number", F.when(~stays, number)).withColumn("goal", F.when(F.col("number").isNotNull(), goal))
    slot = F.when(F.col("goal").isNull(), F.col("place")).otherwise(_at(_array(sizes), F.col("goal")) + F.col("number") - _at(_array(first_lack), F.col("goal")))
    return moved.withColumn("slot", slot.cast("long")).withColumn("shard", F.coalesce("goal", "shard").cast("int")).drop("bucket", "k", "start", "place", "number", "goal")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, groups: str | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row for each row of ``docs(doc_id, text)``.

    Rows whose ``groups`` column is equal are linked; without one, rows of equal texts are, null counting as empty
    (size 8). The law is ``rows``, so ``grown_shard`` is null. Repeated rows are rows of their own; fewer rows than
    shards leave some shards empty; an empty table gives no rows. Texts are read once and not shuffled. The result is
    the same however the rows are dealt to files and tasks.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    data = F.coalesce(F.col("text"), F.lit(""))
    g = F.xxhash64(F.col(groups)) if groups else F.xxhash64(data)
    if groups:
        g = F.when(F.col(groups).isNotNull(), g)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data.cast("binary")).alias("text_crc32"), g.alias("g"))
    # equal rows are counted and written out again by number, a bounded number of them from one array
    counted = read.groupBy("doc_id", "size", "text_crc32", "g").agg(F.count(F.lit(1)).alias("m"))
    blocks = counted.withColumn("b", F.explode(F.expr(f"sequence(0L, (m - 1) div {REPEATS})")))
    numbered = blocks.withColumn("k", F.explode(F.expr(f"sequence(b * {REPEATS} + 1, least(m, (b + 1) * {REPEATS}))"))).drop("b", "m")
    rows = scratch.table(numbered.withColumns({"rid": F.monotonically_increasing_id(), "own": F.xxhash64("doc_id", "text_crc32", "k")}), "rows")
    many = scratch.table(rows.filter("g IS NOT NULL").groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups")
    sized = scratch.table(join_unique(rows, many, ["g"], "n", scratch, "left"), "sized")
    quota = max(1, rows.count() // shards)
    over = F.ceil(F.col("n") / (0.9 * quota))
    dealt = F.when(F.col("n") > quota, F.pmod(F.xxhash64("g") + F.pmod(F.xxhash64("own"), over), F.lit(shards))).otherwise(F.pmod(F.xxhash64("own"), F.lit(shards)))
    labels = sized.select("rid", dealt.cast("int").alias("shard"))
    found = propagate(sized.filter("n IS NOT NULL").select("rid", "g", "n"), labels, shards, rounds, scratch)
    marked = scratch.table(sized.join(found, "rid").withColumn("linked", F.col("n").isNotNull()), "marked")
    out = balance_rows(marked, shards, scratch)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
