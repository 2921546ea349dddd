"""Benchmark decontamination with suffix arrays of the training text.

Words become numbers of the test vocabulary; all others end a run, as does the end of a document, for no match reaches
over them. Every shard (up to 2 MB of documents, or a part of a longer one) becomes a suffix array of its runs: the
places of all words in runs that a window fits in, in the order of what follows them, by prefix doubling. The test side
has a suffix array of its own, built once. Every distinct test window is binary-searched in the shard's array, which
yields all its occurrences as one range; from there, the neighbours of a suffix in the other side's array tell how long
its longest verbatim match is, and where.

A place is listed once however many items share its window, and an item once for each document. The test side is indexed
on the driver in blocks of bounded bytes and broadcast; where the pickled indexes are larger than one broadcast may be,
the corpus is passed once for each group of blocks, carrying the hits found so far in a written table.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, chunks, powers
from .suffix_sort import common_prefix

WINDOW = 10
BLOCK_BYTES = 1 << 20
BROADCAST_BYTES = 32 << 20
SHARD_BYTES = 2 << 20
SHARD_WORDS = 1 << 19
#: Longer items are indexed in parts of so many words, which overlap by one word less than a window.
PART_WORDS = 1 << 15
CHUNK_BYTES = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = True
_WORD[0x80:] = True
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    edges, before = [], False
    for at in range(0, len(data), CHUNK_BYTES):
        inside = _WORD[data[at : at + CHUNK_BYTES]]
        edges.append(np.flatnonzero(inside != np.concatenate(([before], inside[:-1]))) + at)
        before = inside[-1]
    if before:
        edges.append(np.array([len(data)]))
    found = np.concatenate(edges) if edges else np.empty(0, np.int64)
    return found[::2], found[1::2]


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
    """64-bit hashes of words of lower-cased bytes; 0 for words of more than ``longest`` bytes, which need no look-up."""
    out = np.zeros(len(starts), np.uint64)
    fits = np.flatnonzero(ends - starts <= longest)
    starts, ends = starts[fits], ends[fits]
    k = 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + CHUNK_BYTES, "right")))
        first = starts[k]
        i, j = starts[k:stop] - first, ends[k:stop] - first
        part = low[first : ends[stop - 1]]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=sums[1:])
        h = (sums[j] - sums[i]) * down[i] ^ (j - i).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        out[fits[k:stop]] = np.where(h == 0, np.uint64(1), h)
        k = stop
    return out


def words_of(text: str | None) -> list[bytes]:
    low = (text or "").encode().translate(_LOWER)
    starts, ends = word_bounds(np.frombuffer(low, np.uint8))
    return [low[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]


def suffix_ranks(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of word numbers the rank of the sequence from there to the next 0, and the place of that 0.

    Prefix doubling: ranks by h words give ranks by 2h. It ends when no rank splits, or when ``depth`` words are told
    apart; suffixes that are equal so far share a rank. The last number is 0.
    """
    n = len(ids)
    zeros = np.flatnonzero(ids == 0)
    end = zeros[np.searchsorted(zeros, np.arange(n))]
    values, rank = np.unique(ids, return_inverse=True)
    distinct, h = len(values), 1
    place = np.arange(n)
    while h < depth:
        after = np.where(end - place > h, rank[np.minimum(place + h, n - 1)], 0)
        values, rank = np.unique(rank * np.int64(n + 1) + after, return_inverse=True)
        if len(values) == distinct:
            break
        distinct, h = len(values), 2 * h
    return rank, end


def _keys(ids: np.ndarray, at: np.ndarray, end: np.ndarray, width: int, fill: int = 0) -> np.ndarray:
    """The first ``width`` numbers of the suffixes at some places, as bytes that order as they do."""
    k = at[:, None] + np.arange(width)
    found = np.where(k < end[:, None], ids[np.minimum(k, len(ids) - 1)], fill)
    return np.ascontiguousarray(found.astype(">u4")).view(f"S{4 * width}").ravel()


def _shared(a: bytes, i: int, n: int, b: bytes, j: int, m: int) -> int:
    """Words that a[i:n] and b[j:m] have in common at their front; no more is copied than about twice as many bytes."""
    size, step, k = min(n - i, m - j), 64, 0
    while k < size:
        x, y = a[i + k : i + min(size, k + step)], b[j + k : j + min(size, k + step)]
        if x != y:
            return (k + common_prefix(x, y)) // 4
        k += step
        step *= 2
    return size // 4


@dataclass
class SuffixArray:
    raw: bytes  # numbers of four bytes, 0 behind each sequence
    places: np.ndarray  # in the order of their suffixes
    ends: np.ndarray  # of the sequence of each

    def nearest(self, lo: int, hi: int, raw: bytes, at: int, end: int) -> tuple[int, int]:
        """Words of the longest match of raw[at:end] among the suffixes lo to hi, and the number of one that has it."""
        best, found = 0, lo
        while lo < hi:  # both neighbours of the place where it belongs are met on the way
            mid = (lo + hi) // 2
            i, n = 4 * int(self.places[mid]), 4 * int(self.ends[mid])
            k = _shared(self.raw, i, n, raw, 4 * at, 4 * end)
            if k > best:
                best, found = k, mid
            mine, other = raw[4 * (at + k) : min(4 * (at + k + 1), 4 * end)], self.raw[i + 4 * k : min(i + 4 * k + 4, n)]
            if other < mine:
                lo = mid + 1
            else:
                hi = mid
        return best, found

    def alike(self, k: int, lo: int, hi: int, n: int, raw: bytes, at: int, end: int) -> tuple[int, int]:
        """Of the suffixes lo to hi those around number k that have n words in common with raw[at:end], as k has."""

        def fits(x: int) -> bool:
            return _shared(self.raw, 4 * int(self.places[x]), 4 * int(self.ends[x]), raw, 4 * at, 4 * end) >= n

        return bisect_left(range(lo, k), True, key=fits) + lo, bisect_left(range(k, hi), True, key=lambda x: not fits(x)) + k


@dataclass
class TestIndex:
    """The suffix array of one block of test items, cut to distinct windows."""

    vocabulary: np.ndarray  # sorted word hashes; the number of a word is its place plus one
    spelled: list[bytes]  # word of each number, at number - 1
    longest_word: int
    items: list[str]  # distinct item ids as strings, sorted
    array: SuffixArray  # of the suffixes that begin a window
    owner: np.ndarray  # item of each suffix
    first: np.ndarray  # suffixes that begin with window w: first[w] to first[w + 1]
    lengths: np.ndarray  # words of each window
    below: np.ndarray  # least and
    above: np.ndarray  # greatest key of what begins with a window
    item_from: np.ndarray  # items with window w: item_of[item_from[w] : item_from[w + 1]]
    item_of: np.ndarray
    depth: int  # words of the longest item

    @classmethod
    def build(cls, rows: list[tuple[str, list[bytes]]], window: int) -> TestIndex:
        spelled = sorted({w for _, ws in rows for w in ws})
        low = np.frombuffer(b" ".join(spelled), np.uint8)
        hashes = word_hashes(low, *word_bounds(low), 1 << 62)
        if len(set(hashes.tolist())) != len(spelled):
            raise ValueError("two test words share a hash")
        order = np.argsort(hashes)
        number = {spelled[i]: k + 1 for k, i in enumerate(order.tolist())}
        items = sorted({item for item, _ in rows})
        place = {item: k for k, item in enumerate(items)}
        sizes = np.array([len(ws) for _, ws in rows], np.int64)
        ids = np.array([x for _, ws in rows for x in (*(number[w] for w in ws), 0)] or [0], np.int64)
        depth = int(sizes.max(initial=1))
        rank, end = suffix_ranks(ids, depth)
        starts = np.cumsum(sizes + 1) - sizes - 1
        begins = np.concatenate([np.empty(0, np.int64), *(s + np.arange(max(1, n - window + 1)) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True) if n)])
        owner = np.concatenate([np.empty(0, np.int64), *(np.full(max(1, n - window + 1), place[item]) for (item, _), n in zip(rows, sizes.tolist(), strict=True) if n)])
        size = np.minimum(end[begins] - begins, window)
        by = np.lexsort((begins, size, rank[begins]))  # equal up to the end of an item, so that its windows have equal lengths
        begins, owner, size = begins[by], owner[by], size[by]
        below = _keys(ids, begins, end[begins], window)
        new = np.flatnonzero(np.concatenate((below[:1] == below[:1], (below[1:] != below[:-1]) | (size[1:] != size[:-1]))))
        first = np.append(new, len(begins))
        window_of = np.repeat(np.arange(len(new)), np.diff(first))
        pairs = np.unique(window_of * len(items) + owner) if len(begins) else np.empty(0, np.int64)
        above = np.where(size[new] < window, _keys(ids, begins[new], begins[new] + size[new], window, 0xFFFFFFFF), below[new])
        counted = np.searchsorted(pairs, np.arange(len(new) + 1) * max(1, len(items)))
        return cls(hashes[order], [spelled[i] for i in order.tolist()], max(map(len, spelled), default=0), items, SuffixArray(ids.astype(">u4").tobytes(), begins.astype(np.int32), end[begins].astype(np.int32)), owner.astype(np.int32), first, size[new], below[new], above, counted, (pairs % max(1, len(items))).astype(np.int32), depth)


@dataclass
class Shard:
    """Runs of test words of some texts, and their suffix array."""

    array: SuffixArray
    words: np.ndarray  # word of the texts at each place of the runs
    keys: np.ndarray  # first words of each suffix, in order
    rank: np.ndarray  # of each suffix, in order


def _shards(ids: np.ndarray, doc: np.ndarray, index: TestIndex, window: int) -> Iterator[Shard]:
    """Suffix arrays of the runs that a window fits in; runs are dealt, and long ones cut, into shards of bounded size."""
    least = int(index.lengths.min())
    inside = ids > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | (doc[1:] != doc[:-1])
    i, j = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    keep = j - i >= least
    i, j = i[keep], j[keep]
    step = max(SHARD_WORDS, 4 * index.depth) - index.depth
    if len(i) and (j - i).max() > step + index.depth:
        parts = [(a, min(b, a + step + index.depth)) for s, b in zip(i.tolist(), j.tolist(), strict=True) for a in range(s, max(s + 1, b - index.depth + 1), step)]
        i, j = np.array(parts, np.int64).T
    for part in chunks((j - i).tolist(), step + index.depth):
        a, size = i[part], (j - i)[part]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(np.cumsum(size + 1) - size - 1, size)
        words = np.full(int((size + 1).sum()), -1, np.int64)
        words[at] = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
        own = np.where(words < 0, 0, ids[np.maximum(words, 0)])
        rank, end = suffix_ranks(own, index.depth)
        at = at[end[at] - at >= least]
        at = at[np.argsort(rank[at], kind="stable")]
        yield Shard(SuffixArray(own.astype(">u4").tobytes(), at, end[at]), words, _keys(own, at, end[at], window), rank[at])


class _Texts:
    """The words of some texts."""

    def __init__(self, texts: list[bytes]) -> None:
        self.raw = b" ".join(texts).translate(_LOWER)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.starts, self.ends = word_bounds(self.data)
        self.doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.starts, "right")
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.hashes: np.ndarray | None = None
        self.longest = -1

    def numbers(self, index: TestIndex) -> np.ndarray:
        if index.longest_word > self.longest:
            self.hashes, self.longest = word_hashes(self.data, self.starts, self.ends, index.longest_word), index.longest_word
        at = np.minimum(np.searchsorted(index.vocabulary, self.hashes), len(index.vocabulary) - 1)
        return np.where(index.vocabulary[at] == self.hashes, at + 1, 0)

    def hits(self, index: TestIndex, window: int) -> Iterator[tuple[Shard, np.ndarray, np.ndarray, np.ndarray]]:
        """Shards, and the windows found in each with the ranges of suffixes that begin with them."""
        ids = self.numbers(index)
        while len(index.lengths):
            wrong = False
            for shard in _shards(ids, self.doc, index, window):
                lo, hi = np.searchsorted(shard.keys, index.below, "left"), np.searchsorted(shard.keys, index.above, "right")
                found = np.flatnonzero(hi > lo)
                if not len(found):
                    continue
                places, w = _spread(lo[found], hi[found])
                covered = np.zeros(len(shard.words) + 1, np.int32)
                at = shard.array.places[places]
                np.add.at(covered, at, 1)
                np.add.at(covered, at + index.lengths[found[w]], -1)
                for k in shard.words[np.flatnonzero(np.cumsum(covered)[:-1] > 0)].tolist():
                    if self.raw[self.starts[k] : self.ends[k]] != index.spelled[ids[k] - 1]:  # another word of that hash
                        ids[k], wrong = 0, True
                if wrong:
                    break
                yield shard, found, lo[found], hi[found]
            if not wrong:
                return


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some ranges, and the range that each is of."""
    count = hi - lo
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count), np.repeat(np.arange(len(lo)), count)


def _scan(texts: list[bytes], indexes: list[TestIndex], window: int) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]], list[int]]:
    """Of each text: words, hit word ranges, items found, words of the longest match."""
    got = _Texts(texts)
    n = len(texts)
    covered = np.zeros(len(got.starts) + 1, np.int32)
    items: list[set[str]] = [set() for _ in texts]
    longest = np.zeros(n, np.int64)
    for index in indexes:
        known: dict[tuple, list[str]] = {}
        for shard, window_no, lo, hi in got.hits(index, window):
            places, w = _spread(lo, hi)
            words = shard.words[shard.array.places[places]]
            np.add.at(covered, words, 1)
            np.add.at(covered, words + index.lengths[window_no[w]], -1)
            doc = got.doc[words]
            pairs = np.unique(doc * np.int64(len(lo)) + w)
            cut = np.flatnonzero(np.diff(pairs // len(lo), prepend=-1))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(pairs)], strict=True):
                key = tuple(window_no[pairs[a:b] % len(lo)].tolist())
                if key not in known:
                    known[key] = [index.items[k] for k in np.unique(np.concatenate([index.item_of[index.item_from[x] : index.item_from[x + 1]] for x in key])).tolist()]
                items[int(pairs[a] // len(lo))].update(known[key])
            size: dict[tuple, int] = {}  # equal suffixes have equal matches
            for p, x, d in zip(places.tolist(), w.tolist(), doc.tolist(), strict=True):
                key = (int(shard.rank[p]), x)
                if key not in size:
                    v = int(window_no[x])
                    size[key] = index.array.nearest(int(index.first[v]), int(index.first[v + 1]), shard.array.raw, int(shard.array.places[p]), int(shard.array.ends[p]))[0]
                longest[d] = max(longest[d], size[key])
    inside = np.cumsum(covered)[:-1] > 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | (got.doc[1:] != got.doc[:-1])
    ends[:-1] &= ~inside[1:] | (got.doc[1:] != got.doc[:-1])
    ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
    for i, j in zip(np.flatnonzero(begins).tolist(), np.flatnonzero(ends).tolist(), strict=True):
        d = int(got.doc[i])
        ranges[d].append((i - int(got.first[d]), j + 1 - int(got.first[d])))
    return np.diff(got.first).tolist(), ranges, items, longest.tolist()


def merged(ranges: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for i, j in sorted(map(tuple, ranges)):
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(j, out[-1][1]))
        else:
            out.append((i, j))
    return out


def _indexes(items: DataFrame, window: int, block_bytes: int, broadcast_bytes: int) -> Iterator[list[TestIndex]]:
    """The test side in groups of indexes that are small enough, pickled, to be broadcast together."""

    def blocks() -> Iterator[list[tuple[str, list[bytes]]]]:
        held, size = [], 0
        for row in items.toLocalIterator():
            words = words_of(row[1])
            for at in range(0, max(1, len(words) - window + 1), PART_WORDS):
                part = words[at : at + PART_WORDS + window - 1]
                held.append((str(row[0]), part))
                size += sum(map(len, part)) + len(part)
                if size >= block_bytes:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    group, size = [], 0
    for rows in blocks():
        index = TestIndex.build(rows, window)
        bytes_ = len(pickle.dumps(index, pickle.HIGHEST_PROTOCOL))
        if group and size + bytes_ > broadcast_bytes:
            yield group
            group, size = [], 0
        group.append(index)
        size += bytes_
    yield group


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with columns n_words, hit_ranges (merged word ranges inside occurrences), item_ids (sorted as strings),
    longest_match (words) and contaminated; columns of these names are replaced.

    Words are lower-cased in A-Z alone. A window is ``window`` consecutive words of an item; an item with fewer words,
    but some, is one window. Null texts on either side have no words; an empty benchmark marks nothing; repeated rows
    are marked alike and kept; equal items are all reported; a text of any length is taken whole. Matches of items of
    more than ``PART_WORDS`` words are measured up to that length.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "decontam")
    found = [("__ranges", "array<struct<i:int,j:int>>"), ("__items", "array<string>"), ("__longest", "int"), ("__words", "int")]
    docs = docs.drop("n_words", "hit_ranges", "item_ids", "longest_match", "contaminated")
    names = docs.columns
    out = docs.withColumns({c: F.lit(None).cast(kind) for c, kind in found})

    def passed(df: DataFrame, indexes: list[TestIndex]) -> DataFrame:
        shared = spark.sparkContext.broadcast(indexes)
        schema = df.schema
        text_at = names.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [(t or "").encode() for t in b.column(text_at).to_pylist()]
                for part in chunks([len(t) for t in texts], SHARD_BYTES):
                    rows = b.slice(part.start, part.stop - part.start)
                    n_words, ranges, items, longest = _scan(texts[part], shared.value, window)
                    base = len(names)
                    ranges = [merged([*((x["i"], x["j"]) for x in old or ()), *new]) for old, new in zip(rows.column(base).to_pylist(), ranges, strict=True)]
                    items = [sorted({*(old or ()), *new}) for old, new in zip(rows.column(base + 1).to_pylist(), items, strict=True)]
                    longest = [max(old or 0, new) for old, new in zip(rows.column(base + 2).to_pylist(), longest, strict=True)]
                    cols = [pa.array([[{"i": i, "j": j} for i, j in r] for r in ranges], rows.schema.field(base).type), pa.array(items, rows.schema.field(base + 1).type), pa.array(longest, pa.int32()), pa.array(n_words, pa.int32())]
                    yield pa.RecordBatch.from_arrays([*rows.columns[:base], *cols], names=rows.schema.names)

        return df.mapInArrow(run, schema)

    groups = _indexes(benchmark.select("item_id", "text"), window, block_bytes, broadcast_bytes)
    group, before = next(groups), None
    for following in groups:
        out = scratch.table(passed(out, group), "pass")
        if before is not None:
            scratch.drop(before)
        group, before = following, out
    out = passed(out, group)
    hit = F.col("__ranges")
    return out.select(*names, F.col("__words").cast("long").alias("n_words"), hit.alias("hit_ranges"), F.col("__items").alias("item_ids"), F.col("__longest").cast("long").alias("longest_match"), (F.size(hit) > 0).alias("contaminated"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(item_id, words, doc_id, word)``: for each item with an occurring window the longest verbatim match, and a place that has it.

    ``item_id`` is a string. Of equally long matches that of the least doc_id counts, then the first place; a null doc_id
    counts as larger than all others. Every suffix of an item that begins a window is searched in every shard.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    schema = "item_id string, words int, doc_id long, word int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], schema)
    for group in _indexes(benchmark.select("item_id", "text"), window, block_bytes, broadcast_bytes):
        shared = spark.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, texts = b.column(0).to_pylist(), [(t or "").encode() for t in b.column(1).to_pylist()]
                for part in chunks([len(t) for t in texts], SHARD_BYTES):
                    got, best = _Texts(texts[part]), {}
                    for index in shared.value:
                        for shard, found, lo, hi in got.hits(index, window):
                            words = shard.words[shard.array.places]
                            owner = got.doc[words]
                            named = sorted({int(d) for d in owner}, key=lambda d: (ids[part][d] is None, ids[part][d] or 0))
                            turn = np.zeros(len(texts[part]), np.int64)
                            turn[named] = np.arange(len(named))
                            turn = np.argsort(np.lexsort((words, turn[owner])))
                            for w, i, j in zip(found.tolist(), lo.tolist(), hi.tolist(), strict=True):
                                for t in range(int(index.first[w]), int(index.first[w + 1])):
                                    at, end = int(index.array.places[t]), int(index.array.ends[t])
                                    n, k = shard.array.nearest(i, j, index.array.raw, at, end)
                                    first, last = shard.array.alike(k, i, j, n, index.array.raw, at, end)
                                    x = first + int(np.argmin(turn[first:last]))
                                    doc, word = ids[part][owner[x]], int(words[x] - got.first[owner[x]])
                                    item, new = index.items[int(index.owner[t])], (-n, doc is None, doc or 0, word)
                                    best[item] = min(best.get(item, new), new)
                    if best:
                        cols = [list(best), [-v[0] for v in best.values()], [None if v[1] else v[2] for v in best.values()], [v[3] for v in best.values()]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int32()), strict=True)], names=["item_id", "words", "doc_id", "word"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    order = F.struct((-F.col("words")).alias("n"), F.col("doc_id").isNull().alias("z"), "doc_id", "word")
    return out.groupBy("item_id").agg(F.min(order).alias("m")).select("item_id", (-F.col("m.n")).alias("words"), "m.doc_id", "m.word")


def digest(marked: DataFrame) -> DataFrame:
    """The result row of each document: counts, and a digest of the items found."""
    hit = F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda total, r: total + (r["j"] - r["i"]))
    return marked.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(10, len(ws)) AS n, array_to_string(ws[k : k + least(10, len(ws)) - 1], ' ') AS win
       FROM b, unnest(range(1, CAST(len(ws) - least(10, len(ws)) + 2 AS BIGINT))) AS t(k) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, k, array_to_string(ws[k : k + n - 1], ' ') AS win FROM w, lens, unnest(range(1, CAST(len(ws) - n + 2 AS BIGINT))) AS t(k) WHERE len(ws) >= n),
hits AS (SELECT dw.r, dw.k, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, k, n FROM hits), unnest(range(k, k + n)) AS t(p) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
