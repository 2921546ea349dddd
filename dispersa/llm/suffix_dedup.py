"""Removal of every passage that occurs more than once in the corpus, by sparse suffix arrays.

Two equal strings of ``length`` bytes have the same smallest hash among their ``gram``-byte substrings, so both hold an
anchor at the same place. Only anchors, about two in each ``length - gram + 2`` bytes, are candidates. An anchor's
context is all that a string of that length around it can reach. Equal contexts are brought together by 128 bits of
hash, so that each distinct one is sorted once: those that occur twice are repeated throughout, and one of each stands
for all. A context that is unique, though its gram is not, lies at the edge of a repetition; it is compared byte by byte
with the others of its gram. The suffixes to the right of the anchors and the reversed ones to the left are put in order
by deep-shallow sorting, and a string that starts d bytes left of its anchor is repeated if and only if another context
has d bytes in common to the left and ``length - d`` to the right: both are ranges of equal class in the two suffix arrays.

A gram with more than ``group_limit`` different contexts is split by the part that all strings within 18 starting points
share (128 bits of hash again), of which only the few bytes on either side are then sorted. Of a gram with more than
``block_limit`` contexts these parts are counted first; where more contexts than that share one, the strings themselves
are grouped by that hash and their other bytes. So a task sorts a bounded number of rows of one group, and every
repetition is found whatever its group's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, chunks, join_unique, powers, text_bytes
from .suffix_sort import deep_shallow_sort

LENGTH = 200
GRAM = 64
GROUP_LIMIT = 256
BLOCK_LIMIT = 4096
STARTS = 18
PIECE_BYTES = 128 << 10
SORT_ROWS = 8192
#: Rows and bytes that a task holds before it gives them out.
HELD_ROWS, HELD_BYTES = 1 << 15, 2 << 20


def _slide(a: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        a = op(a[:-size], a[size:])
        size *= 2
    return op(a[: len(a) - (width - size)], a[width - size :])


def _anchors_of(pieces: list[bytes], length: int, gram: int) -> list[np.ndarray]:
    """In each piece, the places of grams that are smallest in a string of ``length`` bytes of that piece."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h |= np.uint64(1)
    span = length - gram + 1
    least = _slide(h, span, np.minimum)
    within = np.zeros(len(least), bool)
    for o, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        within[o : o + n - length + 1] = True
    least[~within] = 0
    pad = np.zeros(span - 1, np.uint64)
    places = np.flatnonzero(_slide(np.concatenate((pad, least, pad)), span, np.maximum) == h)
    cut = np.searchsorted(places, np.append(starts, len(data)))
    return [places[a:b] - o for a, b, o in zip(cut[:-1], cut[1:], starts, strict=True)]


def anchor_places(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """Anchors of each text; long texts are taken in pieces that overlap by one byte less than ``length``."""
    pieces, owner = [], []
    for i, t in enumerate(texts):
        if len(t) >= length:
            for at in range(0, max(1, len(t) - length + 1), PIECE_BYTES):
                pieces.append(t[at : at + PIECE_BYTES + length - 1])
                owner.append((i, at))
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for part in chunks([len(p) for p in pieces], PIECE_BYTES):
        for (i, at), places in zip(owner[part], _anchors_of(pieces[part], length, gram), strict=True):
            found[i].append(places + at)
    return [np.unique(np.concatenate(f)) if f else np.empty(0, np.int64) for f in found]


def _context(text: bytes, place: int, length: int, gram: int) -> tuple[int, bytes]:
    """Bytes left of the anchor, and the context."""
    left = min(place, length - gram)
    return left, text[place - left : place + length]


class _Rows:
    """Rows on their way into batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> bool:
        """Whether it is time to take a batch."""
        self.rows.append(row)
        self.size += size
        return self.size >= HELD_BYTES or len(self.rows) >= HELD_ROWS

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [()] * len(self.schema)
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.size = [], 0
        return out


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row for each anchor. ``a`` and ``b`` identify its context: 48 bits of hash of the gram, above 80 of the context.

    ``fresh`` marks the first place of a context in a text.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("place", pa.int32()), ("fresh", pa.bool_())])
    low = np.uint64(0xFFFF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, whole, rows, at, fresh = [], [], [], [], []

            def take(b=b):
                index = pa.array(rows, pa.int32())
                h = np.frombuffer(b"".join(whole), "<u8").reshape(-1, 2)
                a = np.array(grams, np.uint64) & ~low | h[:, 1] & low
                out = pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(h[:, 0].copy().view(np.int64)), b.column(0).take(index), b.column(1).take(index), pa.array(at, pa.int32()), pa.array(fresh, pa.bool_())], schema=schema)
                for held in (grams, whole, rows, at, fresh):
                    held.clear()
                return out

            texts = b.column(2).to_pylist()
            for r, (text, places) in enumerate(zip(texts, anchor_places(texts, length, gram), strict=True)):
                seen = set()
                for p in places.tolist():
                    left, context = _context(text, p, length, gram)
                    key = xxhash.xxh3_128_digest(context, left)
                    grams.append(xxhash.xxh3_64_intdigest(text[p : p + gram]))
                    whole.append(key)
                    rows.append(r)
                    at.append(p)
                    fresh.append(key not in seen)
                    seen.add(key)
                    if len(rows) >= HELD_ROWS:
                        yield take()
            if rows:
                yield take()

    return docs.mapInArrow(run, "a long, b long, doc_id long, th long, place int, fresh boolean")


_WORK = "many boolean, group long, sub long, base int, doc_id long, th long, place int, unsure boolean, left int, context binary"


def _contexts(texts: DataFrame, edges: DataFrame, length: int, gram: int, starts: int) -> DataFrame:
    """What is to be sorted, from the texts and their ``edges(doc_id, th, edge)``.

    An anchor of a gram with few contexts gives its context, in the group of its gram. One of a gram with ``many`` gives
    a row for each run of ``starts`` starting points: the group is of the bytes that the strings of a run share, and
    ``context`` holds only what differs, the bytes left of that part and right of it, as many as a string of the run can
    reach. Runs cover all starting points; the last two overlap.
    """
    types = {"many": pa.bool_(), "group": pa.int64(), "sub": pa.int64(), "base": pa.int32(), "doc_id": pa.int64(), "th": pa.int64(), "place": pa.int32(), "unsure": pa.bool_(), "left": pa.int32(), "context": pa.binary()}
    last = length - gram + 1 - starts
    bases = [*range(0, last, starts), last]
    width = starts - 1

    def rows_of(doc: int | None, th: int, text: bytes, e: dict) -> Iterator[tuple]:
        left, context = _context(text, e["place"], length, gram)
        if not e["many"]:
            yield False, e["k"], 0, 0, doc, th, e["place"], e["unsure"], left, context
            return
        for lo in bases:
            i, j = left - lo, left + length - lo - width
            if i >= 0 and j <= len(context):
                before = min(i, width)
                key = xxhash.xxh3_128_digest(context[i:j], lo)
                yield True, int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True), lo, doc, th, e["place"], e["unsure"], before, context[i - before : i] + context[j : j + width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(pa.schema(list(types.items())))
        for b in batches:
            for doc, th, text, edge in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                for e in edge:
                    for row in rows_of(doc, th, text, e):
                        if out.add(row, len(row[-1])):
                            yield out.take()
        yield out.take()

    return texts.join(edges, _same_row(texts, edges)).select(texts["doc_id"], texts["th"], "text", "edge").mapInArrow(run, _WORK)


def repeated_starts(contexts: list[bytes], lefts: np.ndarray, groups: np.ndarray, highest: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each context the least and largest d up to ``highest`` such that the string of ``length`` bytes that starts d
    bytes left of its anchor is also that of another context of the same group; -1 where there is none."""
    n = len(contexts)
    right = [c[k:] for c, k in zip(contexts, lefts.tolist(), strict=True)]
    back = [c[:k][::-1] for c, k in zip(contexts, lefts.tolist(), strict=True)]
    right_order, right_shared = deep_shallow_sort(right)
    back_order, back_shared = deep_shallow_sort(back)
    right_size = np.array([len(r) for r in right])
    least, most = np.full(n, -1), np.full(n, -1)
    _, group = np.unique(groups, return_inverse=True)
    many = int(group.max()) + 1
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(highest + 1):
        able = np.flatnonzero((lefts >= d) & (right_size >= length - d))
        if len(able) < 2:
            continue
        a[right_order] = np.cumsum(right_shared < length - d)
        b[back_order] = np.cumsum(back_shared < d)
        code = (a[able] * (n + 1) + b[able]) * many + group[able]
        order = np.argsort(code)
        same = code[order][1:] == code[order][:-1]
        hit = able[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        least[hit[least[hit] < 0]] = d
        most[hit] = d
    return least, most


def _resolve(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows of ``_contexts`` to covered spans (doc_id, th, i, j); groups have a bounded number of rows.

    Compared are strings of each context, of ``length`` bytes or of as many as lie outside the shared part; the one that
    starts d bytes left of the context's middle belongs to the string of ``length`` bytes that starts base + d bytes left
    of the anchor.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("i", pa.int32()), ("j", pa.int32())])

    def spans(both: pa.Table) -> Iterator[pa.RecordBatch]:
        many = both.column("many").to_numpy()
        for flag, highest, width in ((False, length - gram, length), (True, STARTS - 1, STARTS - 1)):
            table = both.filter(pa.array(many == flag))
            if not table.num_rows:
                continue
            col = {c: table.column(c).to_numpy() for c in ("group", "sub", "base", "place", "unsure", "left")}
            apart = (col["group"][1:] != col["group"][:-1]) | (col["sub"][1:] != col["sub"][:-1])
            number = np.concatenate(([0], np.cumsum(apart)))
            shared = np.bincount(number)[number] > 1
            if not shared.all():  # a group of one has nothing to be compared with
                table = table.filter(pa.array(shared))
                col = {c: v[shared] for c, v in col.items()}
                number = number[shared]
            if not table.num_rows:
                continue
            least, most = repeated_starts(table.column("context").to_pylist(), col["left"].astype(np.int64), number, highest, width)
            hit = np.flatnonzero((least >= 0) & col["unsure"])
            at = pa.array(hit)
            origin = col["place"].astype(np.int64)[hit] - col["base"].astype(np.int64)[hit]
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().take(at), table.column("th").combine_chunks().take(at), pa.array((origin - most[hit]).astype(np.int32)), pa.array((origin - least[hit] + length).astype(np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SORT_ROWS):
                b = batch.slice(at, SORT_ROWS)
                held.append(b)
                size += b.num_rows
                if size >= SORT_ROWS:
                    table = pa.Table.from_batches(held)
                    group = table.column("group").to_numpy()
                    whole = 0 if group[0] == group[-1] else int(np.flatnonzero(group != group[-1])[-1]) + 1
                    if whole:
                        yield from spans(table.slice(0, whole))
                        held = table.slice(whole).to_batches()
                        size = table.num_rows - whole
        if held:
            yield from spans(pa.Table.from_batches(held))

    return rows.repartition("group").sortWithinPartitions("group", "sub").mapInArrow(run, "doc_id long, th long, i int, j int")


def _strings(rows: DataFrame, starts: int) -> DataFrame:
    """Rows of many contexts to one row for each of their strings: what it has beside the part that the group shares is ``tail``."""
    width = starts - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(pa.schema([("group", pa.int64()), ("sub", pa.int64()), ("d", pa.int32()), ("tail", pa.binary()), ("doc_id", pa.int64()), ("th", pa.int64()), ("place", pa.int32()), ("unsure", pa.bool_())]))
        for b in batches:
            for group, sub, base, doc, th, place, unsure, left, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for d in range(max(0, width - len(ends) + left), min(width, left) + 1):
                    if out.add((group, sub, base + d, ends[left - d : left + width - d], doc, th, place, unsure)):
                        yield out.take()
        yield out.take()

    return rows.select("group", "sub", "base", "doc_id", "th", "place", "unsure", "left", "context").mapInArrow(run, "group long, sub long, d int, tail binary, doc_id long, th long, place int, unsure boolean")


def _same_row(a: DataFrame, b: DataFrame, *more: str):
    on = (a["th"] == b["th"]) & a["doc_id"].eqNullSafe(b["doc_id"])
    for c in more:
        on &= a[c] == b[c]
    return on


def _split_groups(blocks: DataFrame, scratch: Scratch, length: int, gram: int, limit: int) -> DataFrame:
    """Covered spans of contexts whose gram has more contexts than one group may have rows; ``blocks`` is a written table."""
    key = ["group", "sub"]
    counts = scratch.table(blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    spans = _resolve(blocks.join(counts.filter(F.col("n") <= limit).select(*key), key).select(blocks.columns), length, gram)
    hot = counts.filter(F.col("n") > limit)
    if hot.isEmpty():
        return spans
    strings = scratch.table(_strings(join_unique(blocks, hot, key, "n", scratch), STARTS), "strings", "zstd")
    key += ["d", "tail"]
    twice = scratch.table(strings.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "twice", "zstd")
    found = join_unique(strings.filter("unsure"), twice, key, "n", scratch).groupBy("doc_id", "th", "place").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    return spans.unionByName(found.selectExpr("doc_id", "th", "place - b AS i", f"place - a + {length} AS j"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT, block_limit: int = BLOCK_LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, removed, kept)`` for every row of ``docs(doc_id, text)``.

    ``removed`` lists the maximal runs (i, j) of UTF-8 bytes covered by a string of ``length`` bytes that also starts
    elsewhere in the table, in the same text included; ``kept`` is what is left. Null texts count as empty. Repeated
    rows are documents of their own, so all of a repeated text of ``length`` bytes or more goes. Other columns are not
    read; an empty table gives no rows.
    """
    if not 8 <= gram <= length - STARTS:
        raise ValueError(f"gram lies between 8 and length - {STARTS}")
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "repeats")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), text_bytes().alias("text"))
    anchors = _anchors(texts.filter(F.length("text") >= length), length, gram)
    own = F.coalesce("doc_id", "th")  # a row without doc_id goes by its text
    contexts = anchors.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("head")).withColumn("k", F.shiftrightunsigned("a", 16))
    # with the least head too, which keeps the columns of both uses of contexts alike, so that one shuffle serves both
    grams = contexts.groupBy("k").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("different"), F.min("head").alias("first")).filter("total > 1")
    status = scratch.table(contexts.join(grams, "k"), "status", "zstd")
    scratch.release()
    edge = (F.col("different") > 1) & ((F.col("n") == 1) | (own == F.col("head")) & F.col("fresh"))
    marks = join_unique(anchors, status, ["a", "b"], "n", scratch).groupBy("doc_id", "th").agg(
        F.collect_set(F.when(F.col("n") > 1, F.col("place"))).alias("sure"),
        F.collect_set(F.when(edge & (F.col("different") <= block_limit), F.struct("place", (F.col("n") == 1).alias("unsure"), "k", (F.col("different") > group_limit).alias("many")))).alias("edge"),
        F.collect_set(F.when(edge & (F.col("different") > block_limit), F.struct("place", (F.col("n") == 1).alias("unsure"), "k", F.lit(True).alias("many")))).alias("hot"),
    )
    marks = scratch.table(marks, "marks", "zstd")
    scratch.drop(status)
    scratch.release()
    spans = _resolve(_contexts(texts, marks.filter(F.size("edge") > 0).select("doc_id", "th", "edge"), length, gram, STARTS), length, gram)
    hot = marks.filter(F.size("hot") > 0).select("doc_id", "th", F.col("hot").alias("edge"))
    if not hot.isEmpty():
        spans = spans.unionByName(_split_groups(scratch.table(_contexts(texts, hot, length, gram, STARTS), "blocks", "zstd"), scratch, length, gram, block_limit))
        scratch.release()
    spans = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("i", "j")).alias("spans"))
    cover = marks.select("doc_id", "th", "sure", F.lit(None).cast("array<struct<i:int,j:int>>").alias("spans")).unionByName(spans.select("doc_id", "th", F.lit(None).cast("array<int>").alias("sure"), "spans"))
    cover = cover.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("sure")).alias("sure"), F.flatten(F.collect_list("spans")).alias("spans"))
    return _cut(texts.join(cover, _same_row(texts, cover), "left").select(texts["doc_id"], "text", "sure", "spans"), length, gram)


def _cut(rows: DataFrame, length: int, gram: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))), ("kept", pa.binary())])

    def runs(size: int, sure: list[int], spans: list[dict]) -> list[tuple[int, int]]:
        p = np.array(sure, np.int64)
        i, j = np.maximum(0, p - (length - gram)), np.minimum(size, p + length)
        whole = j - i >= length
        i = np.concatenate((i[whole], np.array([s["i"] for s in spans], np.int64)))
        j = np.concatenate((j[whole], np.array([s["j"] for s in spans], np.int64)))
        if not len(i):
            return []
        order = np.argsort(i)
        i, far = i[order], np.maximum.accumulate(j[order])
        new = np.flatnonzero(np.concatenate(([True], i[1:] > far[:-1])))
        return list(zip(i[new].tolist(), far[np.append(new[1:] - 1, len(far) - 1)].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, kept = [], [], []
            for text, sure, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                gone = runs(len(text), sure or [], spans or []) if sure or spans else []
                at, parts = 0, []
                for i, j in gone:
                    parts.append(text[at:i])
                    at = j
                sizes.append(len(text))
                removed.append([{"i": i, "j": j} for i, j in gone])
                kept.append(b"".join((*parts, text[at:])) if gone else text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, schema.field(2).type), pa.array(kept, pa.binary())], schema=schema)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<i:int,j:int>>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda total, r: total + (r["j"] - r["i"]))
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
