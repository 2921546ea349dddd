"""Byte-level BPE by dynamic programming over prefixes.

Merging bytes by rank gives every prefix of a piece one encoding, and that encoding of a prefix extends the encoding of
the prefix before its last token. So the last token of each prefix is all that needs storing: it is the one vocabulary
token that ends there and that merging would not have joined differently with the token before it. Appending bytes
continues the table; after an edit only the entries behind it are computed anew, until as many of them as the longest
token has bytes agree with the old ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, chunks, text_bytes

#: Pieces and token seams that a worker remembers; beyond that it starts afresh, which costs time alone.
CACHE_PIECES = 400_000
SEAMS = 400_000
#: Characters whose new pieces are encoded together, in order.
LEARN_CHARS = 1 << 20
CACHE_PIECE_BYTES = 64
MAX_RANK_BYTES = 64 << 20


class Vocabulary:
    """Ranks of byte strings, as a rank file of base64 tokens and numbers holds them."""

    def __init__(self, data: bytes) -> None:
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.bytes_of = {i: t for t, i in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self._splits: dict[int, tuple[int, int] | None] = {}
        self._valid: dict[int, bool] = {}
        found = ahocorasick.Automaton()
        for t, i in self.rank.items():
            if self.split(i) is not None:  # merging makes it
                found.add_word(t.decode("latin-1"), (i, len(t)))
        found.make_automaton()
        #: Places and tokens that end there, with their lengths, of bytes as Latin-1.
        self.ending = found.iter

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; itself twice for one byte; None if merging never makes it."""
        if token not in self._splits:
            parts = [self.rank[bytes((c,))] for c in self.bytes_of[token]]
            last = (token, token) if len(parts) == 1 else None
            while len(parts) > 1:
                ranks = [self.rank.get(self.bytes_of[a] + self.bytes_of[b]) for a, b in zip(parts, parts[1:], strict=False)]
                best = min((r for r in ranks if r is not None), default=None)
                if best is None:
                    break
                k = ranks.index(best)
                last = (parts[k], parts[k + 1])
                parts[k : k + 2] = [best]
            self._splits[token] = last if parts == [token] else None
        return self._splits[token]

    def stays(self, left: int, right: int) -> bool:
        """Whether merging leaves these two tokens side by side: undoes the merges at the seam, latest first."""
        key = left << 32 | right
        known = self._valid.get(key)
        if known is None:
            if len(self._valid) >= SEAMS:
                self._valid.clear()
            known = self._valid[key] = self._stays(left, right)
        return known

    def _stays(self, left: int, right: int) -> bool:
        before = None  # a merge over the seam of a rank under this would have come first
        while True:
            over = self.rank.get(self.bytes_of[left] + self.bytes_of[right])
            if over is not None and (before is None or over < before):
                return False
            a, b = self.split(left), self.split(right)
            open_left, open_right = a[1] != left, b[0] != right
            if open_left and (left > right or not open_right):
                before, left = left, a[1]
            elif open_right:
                before, right = right + 1, b[0]  # of equal merges the one further left comes first
            else:
                return True


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extends the piece; entries of the old prefixes stay as they are."""
        self.data += more
        self._fill(len(self.data))

    def _fill(self, stop: int) -> None:
        v, data, last = self.vocabulary, self.data, self.last
        known, stays, done = v._valid.get, v.stays, len(last)
        base = done + 1 - v.longest if done >= v.longest else 0
        for at, (token, size) in v.ending(data[base:stop].decode("latin-1")):
            end = base + at + 1
            if end <= done:
                continue
            start = end - size
            if start:
                left = last[start - 1]
                valid = known(left << 32 | token)
                if not (valid or valid is None and stays(left, token)):
                    continue
            last.append(token)
            done += 1
        if done < stop:
            raise ValueError("the vocabulary lacks a byte")

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts ``new`` in place of bytes start to stop; returns how many entries were computed."""
        old_last, old_size = self.last, len(self.data)
        shift = len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old_last[:start]
        same = done = 0
        reach = self.vocabulary.longest
        for end in range(start + 1, len(self.data) + 1):
            self._fill(end)
            token = self.last[-1]
            done += 1
            behind = end - start - len(new)  # bytes after the edit within this prefix
            same = same + 1 if behind > 0 and token == old_last[end - shift - 1] else 0
            if same >= reach and behind >= reach:
                self.last += old_last[end - shift : old_size]
                break
        return done

    def tokens(self, size: int | None = None) -> list[int]:
        """The encoding of the whole piece, or of its first ``size`` bytes."""
        end, out = len(self.data) if size is None else size, []
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Encoder:
    """Splits texts by a pattern and encodes each match by its prefix table, remembering short pieces."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        self.vocabulary, self.pieces = Vocabulary(ranks), regex.compile(pattern).findall
        self._seen: dict[str, str] = {}
        self._spelled = {str(i): t for i, t in self.vocabulary.bytes_of.items()}

    def piece(self, text: str) -> list[int]:
        data = text.encode()
        whole = self.vocabulary.rank.get(data)
        return [whole] if whole is not None else PrefixTable(self.vocabulary, data).tokens()

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self.piece(p)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))

    def _joined(self, text: str) -> str:
        got = ",".join(map(str, self.piece(text)))
        if len(text) <= CACHE_PIECE_BYTES:
            self._seen[text] = got
        return got

    def _learn(self, pieces: set[str]) -> None:
        """Encodes new pieces in order, each as an append to the prefix it shares with the one before."""
        rank, bytes_of = self.vocabulary.rank, self.vocabulary.bytes_of
        table = PrefixTable(self.vocabulary)
        for data in sorted(p.encode() for p in pieces):
            whole = rank.get(data)
            if whole is not None:
                self._seen[data.decode()] = str(whole)
                continue
            old, shared = table.data, 0
            most = min(len(old), len(data))
            while shared < most and old[shared] == data[shared]:
                shared += 1
            del table.last[shared:]
            table.data = data
            table._fill(len(data))
            last, end, ids = table.last, len(data), []
            while end:
                token = last[end - 1]
                ids.append(str(token))
                end -= len(bytes_of[token])
            self._seen[data.decode()] = ",".join(ids[::-1])

    def joined(self, texts: list[str]) -> list[str]:
        """The ids of each text, as decimals joined by commas."""
        out = []
        for part in chunks([len(t) for t in texts], LEARN_CHARS):
            split = [self.pieces(t) for t in texts[part]]
            if len(self._seen) >= CACHE_PIECES:
                self._seen.clear()
            new = set().union(*split).difference(self._seen)
            self._learn({p for p in new if len(p) <= CACHE_PIECE_BYTES})
            seen, other = self._seen.get, self._joined
            out += [",".join([seen(p) or other(p) for p in pieces]) for pieces in split]
        return out

    def decode_joined(self, ids: str) -> bytes:
        return b"".join(map(self._spelled.__getitem__, ids.split(","))) if ids else b""


_encoders: dict[bytes, Encoder] = {}


def encoder(ranks: bytes, pattern: str) -> Encoder:
    """One encoder for each vocabulary and worker."""
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def read_ranks(path: str) -> bytes:
    """A rank file, which is broadcast: its size does not depend on the data and is checked."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"the rank file exceeds {MAX_RANK_BYTES} bytes")
    return data


def _id_lists(joined: list[str]) -> pa.Array:
    """Arrays of ids from decimals joined by commas, without a Python object for each id."""
    ids = [np.fromstring(j, np.int32, sep=",") for j in joined]
    ends = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """``docs`` with ``token_ids`` (array of int), the encoding of ``text``; a column of that name is replaced.

    Null and empty texts have no tokens. Repeated rows are encoded alike; an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("token_ids")
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    at = docs.columns.index("text")
    schema = docs.withColumn("token_ids", F.array().cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(*shared.value)
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            for part in chunks([len(t) for t in texts], LEARN_CHARS):
                rows = b.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*rows.columns, _id_lists(own.joined(texts[part]))], names=[*b.schema.names, "token_ids"])

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row; null texts count as empty."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(*shared.value)
        for b in batches:
            n, ids, decoded = [], [], []
            texts = [t.decode() for t in b.column(1).to_pylist()]
            for part in chunks([len(t) for t in texts], LEARN_CHARS):
                for joined in own.joined(texts[part]):
                    n.append(joined.count(",") + 1 if joined else 0)
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode_joined(joined)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
