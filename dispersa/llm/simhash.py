"""SimHash near-duplicates linked through deletion-variant signatures.

Two 64-bit fingerprints within three bits agree in one of their two 32-bit halves up to one bit. So each distinct
fingerprint is indexed under its two exact halves and under the 64 variants that leave one bit of a half out; equal keys
meet in one sort, and every candidate pair is verified on all 64 bits. A key that more than ``bucket_limit``
fingerprints share is split by the same rule over the bits it leaves free (halves of 16, then of 8 bits): the last level
fixes at least 53 bits, so a bucket there holds 2,048 fingerprints at most, and no link is lost. Keys of the halves that
most fingerprints share are known beforehand, and their rows go to the second level without meeting in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, Scratch, as_batch, bound_batches, join_unique, text_bytes
from .components import connected_components

SEED = 42
WINDOW = 3
MAX_BITS = 3
BUCKET_LIMIT = 2048


def simhash(text: bytes, window: int = WINDOW) -> int:
    """The unsigned fingerprint of UTF-8 bytes; 0 without words."""
    words = text.lower().split()  # on bytes both touch ASCII alone
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= window:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - window])).tolist()
    ends = (ends[window - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, ends, strict=True)), np.uint64, len(ends))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs(doc_id, text)``; fp is the fingerprint as a signed long."""
    bound_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([simhash(t, window) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield as_batch(schema, [b.column(0), values])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, fp long")


def _variants(value: str, width: int):
    """SQL: exact value of each of the two parts of a ``width``-bit number, and each with one bit left out."""
    half = width // 2
    mask = (1 << half) - 1
    parts = f"array(shiftrightunsigned({value}, {half}) & {mask}L, {value} & {mask}L)"
    return (
        f"transform(sequence(0, {2 * half + 1}), t -> named_struct('tag', cast(t AS long), 'bits', "
        f"element_at({parts}, cast(t div {half + 1} AS int) + 1) & CASE WHEN t % {half + 1} = {half} THEN {mask}L ELSE {mask}L ^ shiftleft(1L, cast(t % {half + 1} AS int)) END))"
    )


def _free(value: str, tag: str, width: int) -> str:
    """SQL: the part that a tag of ``_variants`` says nothing about."""
    half = width // 2
    mask = (1 << half) - 1
    return f"CASE WHEN {tag} < {half + 1} THEN {value} & {mask}L ELSE shiftrightunsigned({value}, {half}) & {mask}L END"


def _spanning(fps: np.ndarray, max_bits: int, side: np.ndarray | None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within ``max_bits``; with ``side``, of those whose sides differ."""
    edges = []
    open_ = np.arange(len(fps))
    while len(open_):
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            x = queue.pop()
            near = np.bitwise_count(fps[open_] ^ fps[x]) <= max_bits
            if side is not None:
                near &= side[open_] != side[x]
            hits = open_[near]
            if len(hits):
                open_ = open_[~near]
                edges += [(x, y) for y in hits]
                queue += hits.tolist()
    return edges


def _bucket_edges(rows: DataFrame, max_bits: int, limit: int, first_level: bool) -> DataFrame:
    """Links among rows ``(key, fp)`` of equal key, each key's as a forest; rows of a key over ``limit`` come back with that key."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])

    def links(keys: np.ndarray, fps: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        sizes = np.diff(bounds)
        out = []
        bit = _left_out(keys) if first_level else None
        twos = bounds[:-1][sizes == 2]
        x, y = fps[twos], fps[twos + 1]
        near = np.bitwise_count(x ^ y) <= max_bits
        if bit is not None:
            b = bit[twos]
            near &= (b < 0) | (((x ^ y) >> np.where(b < 0, 0, b).astype(np.uint64)) & np.uint64(1)).astype(bool)
        out += list(zip(x[near].tolist(), y[near].tolist(), strict=True))
        for i, n in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            f = fps[i : i + n]
            side = None
            if bit is not None and bit[i] >= 0:
                side = (f >> np.uint64(bit[i])) & np.uint64(1)
                if side.min() == side.max():
                    continue
            out += [(int(f[p]), int(f[q])) for p, q in _spanning(f, max_bits, side)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        hot = None

        def finish(keys, fps):
            bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            pairs = links(keys, fps, bounds)
            ends = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return as_batch(schema, [ends[:, 0], ends[:, 1], pa.nulls(len(ends), pa.int64())])

        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if hot is not None:
                n = int(np.searchsorted(k, hot, "right")) if len(k) and k[0] == hot else 0
                if n:
                    yield as_batch(schema, [f[:n].view(np.int64), pa.nulls(n, pa.int64()), k[:n]])
                    k, f = k[n:], f[n:]
                if not len(k):
                    continue
                hot = None
            k, f = np.concatenate((held_k, k)), np.concatenate((held_f, f))
            if not len(k):
                continue
            sizes_at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
            sizes = np.diff(sizes_at)
            large = sizes > limit
            for i, n in zip(sizes_at[:-1][large].tolist(), sizes[large].tolist(), strict=True):
                yield as_batch(schema, [f[i : i + n].view(np.int64), pa.nulls(n, pa.int64()), k[i : i + n]])
            last = int(sizes_at[-2])
            if large[-1]:
                hot = int(k[-1])
                held_k, held_f = held_k[:0], held_f[:0]
            else:
                held_k, held_f = k[last:], f[last:]
            keep = np.repeat(~large, sizes)
            keep[last:] = False
            if keep.any():
                yield finish(k[keep], f[keep])
        if len(held_k):
            yield finish(held_k, held_f)

    return rows.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, key long")


def _left_out(keys: np.ndarray) -> np.ndarray:
    """The bit of the fingerprint that a key of the first level leaves out; -1 for exact halves."""
    tag = keys >> 32
    place = tag % 33
    return np.where(place == 32, -1, place + np.where(tag < 33, 32, 0))


def link_fingerprints(fps: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``(a, b)`` links of distinct ``fps(fp)``: a forest within each bucket, whose union connects just what links connect."""
    if max_bits > 3:
        raise ValueError("two halves with one bit left out cover three differing bits at most")
    bound_batches(fps.sparkSession)
    rows = fps.selectExpr("fp", f"explode({_variants('fp', 64)}) AS v").selectExpr("fp", "shiftleft(v.tag, 32) | v.bits AS key")
    # a key of more than bucket_limit fingerprints comes from a half that more than half as many share
    halves = fps.selectExpr("explode(array(struct(0L AS t, shiftrightunsigned(fp, 32) AS half), struct(1L AS t, fp & 4294967295L AS half))) AS x").groupBy("x.t", "x.half").count()
    common = scratch.table(halves.filter(F.col("count") > bucket_limit / 2).orderBy(F.desc("count"), "t", "half").limit(HOT_KEYS // 33), "halves")
    hot = None
    if not common.isEmpty():
        bits = "half & CASE WHEN b = 32 THEN 4294967295L ELSE 4294967295L ^ shiftleft(1L, cast(b AS int)) END"
        known = F.broadcast(common.selectExpr("t", "half", "explode(sequence(0L, 32L)) AS b").selectExpr(f"shiftleft(t * 33 + b, 32) | ({bits}) AS key").distinct())
        hot = rows.join(known, "key", "left_semi").select("fp", "key")
        rows = rows.join(known, "key", "left_anti")
    first = scratch.table(_bucket_edges(rows, max_bits, bucket_limit, True), "level1")
    edges = first.filter("b IS NOT NULL").select("a", "b")
    more = first.filter("b IS NULL").selectExpr("a AS fp", "key")
    hot = more if hot is None else hot.unionByName(more)
    if hot.isEmpty():
        return edges
    rows = hot.selectExpr("fp", "key", f"{_free('fp', 'shiftright(key, 32)', 64)} AS free").selectExpr("fp", "key", "free", f"explode({_variants('free', 32)}) AS v")
    rows = rows.selectExpr("fp", "shiftleft(key, 22) | shiftleft(v.tag, 16) | v.bits AS key")
    second = scratch.table(_bucket_edges(rows, max_bits, bucket_limit, False), "level2")
    edges = edges.unionByName(second.filter("b IS NOT NULL").select("a", "b"))
    hot = second.filter("b IS NULL").selectExpr("a AS fp", "key")
    if hot.isEmpty():
        return edges
    free = hot.selectExpr("fp", "key", f"{_free('fp', 'shiftright(key, 54)', 64)} AS free")
    free = free.selectExpr("fp", "key", f"{_free('free', 'shiftright(key, 16) & 63', 32)} AS free")
    rows = free.selectExpr("fp", "key", f"explode({_variants('free', 16)}) AS v").selectExpr("fp", "xxhash64(key, v.tag, v.bits) AS key")
    third = scratch.table(_bucket_edges(rows, max_bits, 1 << 20, False), "level3")
    return edges.unionByName(third.select("a", "b"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, window: int = WINDOW, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs(doc_id, text)``.

    Null and empty texts and texts of white space have fingerprint zero and are linked like any other. Repeated rows
    come back as often as they came. ``component_id`` is the smallest doc_id reachable through links, itself included;
    null only where every row reached has a null doc_id. Other columns are not read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.table(fingerprints(docs, window), "fp")
    heads = scratch.table(marked.groupBy("fp").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")), "heads")
    roots = scratch.table(connected_components(link_fingerprints(heads.select("fp"), scratch, max_bits, bucket_limit), scratch), "roots")
    named = scratch.table(heads.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "head", "root"), "named")
    least = scratch.table(named.groupBy("root").agg(F.min("head").alias("component_id"), F.count(F.lit(1)).alias("size")), "least")
    linked = join_unique(named, least, ["root"], "size", scratch).select("fp", "component_id")
    classes = scratch.table(heads.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "head").alias("component_id")), "classes")
    return join_unique(marked, classes, ["fp"], "n", scratch).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
