"""Token counts of parts of a document from one encoding of the whole.

A text is encoded once; token byte lengths give each token a span of characters (those its bytes belong to), and the
spans are joined to the sections by their offsets: both are sorted, so a binary search of the section's ends among the
token spans is the interval join. Tokens that cross a section's border are allotted by an explicit rule:

``first``     to the section of the token's first character: counts over a partition of the text add up to the total;
``last``      to that of its last character, likewise;
``touching``  to every section it shares a character with;
``inside``    to a section that holds all of it, else to none;
``share``     to each section in proportion to the characters it shares (fractions add up to the total).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

RULES = ("first", "last", "touching", "inside", "share")
_encodings: dict[bytes, tuple[tiktoken.Encoding, np.ndarray]] = {}


def _encoding(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        sizes = np.zeros(max(table.values()) + 1, np.int64)
        for token, i in table.items():
            sizes[i] = len(token)
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}), sizes
    return _encodings[key]


def token_spans(text: str, encoding: tiktoken.Encoding, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of each token's characters; tokens that split a character share it."""
    ids = np.asarray(encoding.encode_ordinary(text), np.int64)
    stops = np.cumsum(sizes[ids])
    begins = stops - sizes[ids]
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) == len(text):
        return begins, stops
    number = np.cumsum((data & 0xC0) != 0x80) - 1  # of the character that each byte belongs to
    return number[begins], number[stops - 1] + 1


def count_in_spans(first: np.ndarray, end: np.ndarray, sections: list[tuple[int, int]], rule: str) -> np.ndarray:
    """Tokens of each section ``[i, j)`` by the rule; sections may overlap, leave gaps and come in any order."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    if not sections:
        return np.zeros(0)
    i, j = np.array(sections, np.int64).T
    find = np.searchsorted
    if rule == "first":
        got = find(first, j) - find(first, i)
    elif rule == "last":
        got = find(end - 1, j) - find(end - 1, i)
    elif rule == "touching":
        got = find(first, j) - find(end, i, "right")
    elif rule == "inside":
        got = find(end, j, "right") - find(first, i)
    else:
        held = np.concatenate(([0.0], np.cumsum(np.ones(len(first)))))
        width = np.maximum(1, end - first)

        def below(x: np.ndarray) -> np.ndarray:
            """Tokens before character x, those across it in part."""
            whole = find(end, x, "right")
            out = held[whole].copy()
            for k in range(4):  # at most four tokens share a character, so no more than that many lie across a point
                at = whole + k
                ok = at < len(first)
                at = np.minimum(at, max(0, len(first) - 1))
                if len(first):
                    out += np.where(ok, np.clip((x - first[at]) / width[at], 0, 1), 0)
            return out

        got = below(j) - below(i)
    return np.where(j > i, np.maximum(got, 0), 0)


def lines(text: str) -> list[tuple[int, int]]:
    """Sections of a text that end behind each line feed; none for an empty text."""
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        out.append((at, end))
        at = end
    return out


def attribute_tokens(docs: DataFrame, ranks: bytes, pattern: str, rule: str = "first", sections: str | None = None) -> DataFrame:
    """``(doc_id, section, char_start, char_end, n_tokens, doc_tokens)``, a row for each section of each document.

    Sections are the lines of ``text``, or those in the column named ``sections`` (array of struct<start, end>, code
    points; parts beyond the text hold nothing). Null and empty texts and null sections give no rows; repeated rows
    give theirs again. ``n_tokens`` is a double under the rule ``share`` and a long otherwise.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    number = (pa.float64(), "double") if rule == "share" else (pa.int64(), "long")
    schema = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("n_tokens", number[0]), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = _encoding(*shared.value)
        for b in batches:
            given = b.column(2).to_pylist() if sections else [None] * b.num_rows
            ids, parts, counts, totals = [], [], [], []
            for doc, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), given, strict=True):
                if not text:
                    continue
                spans = lines(text) if not sections else [(s["start"], s["end"]) for s in own or () if s]
                if not spans:
                    continue
                first, end = token_spans(text, encoding, sizes)
                ids.append((doc, len(spans)))
                parts.append(np.array(spans, np.int32))
                counts.append(count_in_spans(first, end, spans, rule))
                totals.append(len(first))
            if not ids:
                continue
            n = [k for _, k in ids]
            bounds = np.concatenate(parts)
            doc = pa.array([d for d, _ in ids], pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), n)))
            yield pa.RecordBatch.from_arrays([doc, pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n])), pa.array(bounds[:, 0]), pa.array(bounds[:, 1]), pa.array(np.concatenate(counts).astype(number[0].to_pandas_dtype())), pa.array(np.repeat(totals, n))], schema=schema)

    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text"] + ([F.col(sections)] if sections else [])
    return docs.select(*columns).mapInArrow(run, f"doc_id long, section int, char_start int, char_end int, n_tokens {number[1]}, doc_tokens long")
