"""Secrets in texts and in what is encoded within them.

A worklist starts with the text. Each layer is scanned, then unwrapped in every way that applies: percent escapes,
Unicode escapes, base64 runs and compressed streams; what comes out is a further layer until nothing new does. Each
layer knows which characters of the text each of its own came from, so that a span found in any layer is mapped back.
A layer seen before at the same place is not taken up again, so a stream that unpacks to itself ends.

Base64 runs are joined over line breaks and decoded at every alignment, as other characters may be glued to their front.
Bytes that are not UTF-8 are taken as Latin-1, so no layer is left out for what else stands in it, and ASCII in UTF-16 or
UTF-32 is a further layer. Compressed streams are read to their end. One of more than ``LAYER_BYTES`` goes by in windows
that overlap by a quarter, each scanned and unwrapped before the next is read, so memory does not grow with what a
stream holds.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

KINDS = ("assign", "access", "hex")
#: Bytes of a compressed stream that are held at once; a longer one is read in overlapping windows and marked.
LAYER_BYTES = 16 << 20
#: Bytes that a stream is fed, and that it gives, at a time.
FEED_BYTES, STEP_BYTES = 1 << 10, 1 << 20

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2})|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}")
_BASE64_URL = re.compile(r"[A-Za-z0-9_-]{16,}={0,2}")
#: Runs over line breaks and indentation, breaks written as escapes included. A run is entered at its first character only.
_BREAK = re.compile(r"[ \t]*+(?:(?:\r\n|\r|\n|(?:\\r)?\\n)[ \t]*+)++")
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{4,}}+(?:{_BREAK.pattern}[A-Za-z0-9+/_-]++)++")
#: How the magic bytes of compressed streams begin in base64.
_PACKED = re.compile(r"H4sI|Qlpo|KLUv/|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]")
#: Without one of these, decoded bytes hold neither a match nor anything to unwrap.
_HOT = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[uUxnr]|&#|[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-]{4}[ \t]*+[\r\n]|(?:[\t\n\r\x20-\x7e]\x00){6}|(?:[\t\n\r\x20-\x7e]\x00\x00\x00){6}")
_WIDE_CHARACTER = re.compile(r"[^\x00](?:\x00\x00\x00|\x00)")
_WIDE = re.compile(r"(?:[\t\n\r\x20-\x7e](?:\x00\x00\x00|\x00)){6,}")


def scan(text: str) -> list[tuple[str, int, int]]:
    """Base matches ``(kind, start, end)`` in code points, leftmost and non-overlapping within each kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


class _Layer:
    __slots__ = ("ends", "path", "starts", "text")

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray, path: tuple[str, ...]) -> None:
        self.text, self.starts, self.ends, self.path = text, starts, ends, path

    @classmethod
    def at(cls, text: str, first: int, last: int, path: tuple[str, ...]) -> _Layer:
        """A layer all of whose characters came from the same place."""
        return cls(text, *(np.broadcast_to(np.int64(x), len(text)) for x in (first, last)), path)


def _decoded(data: bytes) -> tuple[str, list[int]]:
    """Bytes as text, and the bytes of each character: UTF-8 or else Latin-1, which takes any byte."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1"), [1] * len(data)
    return text, [1] * len(text) if len(text) == len(data) else [len(c.encode()) for c in text]


def _percent(found: str) -> tuple[str, list[int]]:
    """A run of percent escapes: its text, and the width in the run of each character."""
    text, widths = _decoded(bytes.fromhex(found.replace("%", "")))
    return text, [3 * n for n in widths]


def _wide(found: str) -> tuple[str, list[int]]:
    """A run of ASCII in UTF-16 or UTF-32."""
    return found.replace("\x00", ""), [len(x) for x in _WIDE_CHARACTER.findall(found)]


def _escape(found: str) -> tuple[str, list[int]] | None:
    if found.startswith("&#"):
        code = int(found[3:-1], 16) if found[2] in "xX" else int(found[2:-1])
    elif found.startswith("\\u{"):
        code = int(found[3:-1], 16)
    elif len(found) == 12:
        code = 0x10000 + ((int(found[2:6], 16) - 0xD800) << 10) + int(found[8:], 16) - 0xDC00
    else:
        code = int(found[2:], 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return chr(code), [len(found)]


def _rewritten(layer: _Layer, pattern: re.Pattern, decode, name: str) -> _Layer | None:
    """The layer with every escape replaced by what it stands for."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        got = decode(m.group())
        if got is None:
            continue
        text, widths = got
        i, j = m.span()
        stops = i + np.cumsum(widths)
        parts += [layer.text[at:i], text]
        starts += [layer.starts[at:i], layer.starts[np.concatenate(([i], stops[:-1]))]]
        ends += [layer.ends[at:i], layer.ends[stops - 1]]
        at = j
    if not parts:
        return None
    return _Layer("".join((*parts, layer.text[at:])), np.concatenate((*starts, layer.starts[at:])), np.concatenate((*ends, layer.ends[at:])), (*layer.path, name))


def _packing(head: bytes) -> str | None:
    """The kind of compressed stream that begins with ``head``."""
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if len(head) > 2 and head[0] == 0x78 and (head[0] << 8 | head[1]) % 31 == 0:
        return "zlib"
    if head[:3] == b"BZh":
        return "bzip2"
    return "zstd" if head[:4] == b"\x28\xb5\x2f\xfd" else None


class _Steps:
    """Bytes that come in steps, read like a file."""

    def __init__(self, steps: Iterator[bytes]) -> None:
        self.steps, self.rest = steps, b""

    def read(self, n: int) -> bytes:
        while len(self.rest) < n and (more := next(self.steps, None)) is not None:
            self.rest += more
        out, self.rest = self.rest[:n], self.rest[n:]
        return out


def _unpacked(kind: str, source: Callable[[], Iterator[bytes]]) -> Iterator[bytes]:
    """What the compressed bytes of ``source`` hold, in steps; a broken stream ends where it breaks."""
    try:
        if kind == "zstd":
            with zstandard.ZstdDecompressor().stream_reader(_Steps(source()), read_size=FEED_BYTES, read_across_frames=True) as r:
                while out := r.read1(STEP_BYTES):
                    yield out
            return
        make = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bzip2": bz2.BZ2Decompressor}[kind]
        d = make()
        for data in source():
            for i in range(0, len(data), FEED_BYTES):
                feed = data[i : i + FEED_BYTES]
                while True:
                    out = d.decompress(feed, STEP_BYTES)
                    if out:
                        yield out
                    if d.eof:
                        feed, d = d.unused_data, make()
                        if not feed:
                            break
                    else:
                        feed = b"" if kind == "bzip2" else d.unconsumed_tail
                        if not out and not feed:
                            break
    except (zlib.error, OSError, zstandard.ZstdError, EOFError, ValueError):
        return


def _windows(steps: Iterator[bytes], size: int) -> Iterator[tuple[bytes, bool]]:
    """All bytes in windows of about ``size`` that overlap by a quarter, and whether there are several."""
    held, several, fresh = bytearray(), False, False
    for more in steps:
        held += more
        fresh = True
        if len(held) > size:
            several = True
            yield bytes(held), True
            del held[: len(held) - size // 4]
            fresh = False
    if fresh:
        yield bytes(held), several


def _streams(data: bytes, first: int, last: int, path: tuple[str, ...], size: int, seen: dict) -> Iterator[tuple[_Layer, bool]]:
    """The layers of a compressed stream and of those it consists of, and whether each is a window of a longer one."""
    source = lambda: iter((data,))
    key = (hashlib.sha256(data).digest(), first, last)
    while seen.get(key, len(path) + 1) > len(path) and (kind := _packing(_Steps(source()).read(4))):
        seen[key] = len(path)
        source, path, digest = partial(_unpacked, kind, source), (*path, kind), hashlib.sha256()
        for window, several in _windows(source(), size):
            yield _Layer.at(_decoded(window)[0], first, last, path), several
        for step in source():
            digest.update(step)
        key = (digest.digest(), first, last)


def _runs(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Base64 runs, joined over line breaks as well, in the usual alphabet, and the pieces of the text they consist of."""
    spans = {m.span() for m in _BASE64.finditer(text)}
    if "-" in text or "_" in text:
        spans |= {m.span() for m in _BASE64_URL.finditer(text)}
    found = [[x] for x in sorted(spans)]
    for m in _WRAPPED.finditer(text):
        at, pieces = m.start(), []
        for x in _BREAK.finditer(text, *m.span()):
            pieces.append((at, x.start()))
            at = x.end()
        found.append([*pieces, (at, m.end())])
    for pieces in found:
        body = "".join(text[i:j] for i, j in pieces).rstrip("=").replace("-", "+").replace("_", "/")
        if len(body) >= 16:
            yield body, pieces


def _bytes(body: str) -> bytes:
    body = body[:-1] if len(body) % 4 == 1 else body
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _begins(body: str) -> bool:
    """Whether a stream may begin here: zlib has a short mark, found by chance, but most such streams break early."""
    if body[0] == "e":
        try:
            zlib.decompressobj().decompress(_bytes(body[:4096]), 1)
        except zlib.error:
            return False
    return True


def _base64_layers(layer: _Layer, size: int, seen: dict) -> Iterator[tuple[_Layer, bool]]:
    """The layers that base64 runs hold, and whether each is a window of a longer stream.

    What precedes a run may be glued to it, so each is decoded at all four offsets and from every mark of a stream.
    """
    path = (*layer.path, "base64")
    for body, pieces in _runs(layer.text):
        places = None
        for k in range(4):
            data = _bytes(body[k:])
            if not _HOT.search(data):
                continue
            text, widths = _decoded(data)
            if not layer.starts.strides[0]:
                yield _Layer.at(text, int(layer.starts[0]), int(layer.ends[0]), path), False
                continue
            if places is None:
                places = np.concatenate([np.arange(i, j) for i, j in pieces])[: len(body)]
            stops = np.cumsum(widths)
            begin = np.concatenate(([0], stops[:-1]))
            yield _Layer(text, layer.starts[places[k + begin * 4 // 3]], layer.ends[places[np.minimum(k - (-stops * 4 // 3), len(body)) - 1]], path), False
        for m in _PACKED.finditer(body):
            if _begins(body[m.start() :]):
                if places is None:
                    places = np.concatenate([np.arange(i, j) for i, j in pieces])[: len(body)]
                yield from _streams(_bytes(body[m.start() :]), int(layer.starts[places[m.start()]]), int(layer.ends[places[-1]]), path, size, seen)


def _inner(layer: _Layer, size: int, seen: dict) -> Iterator[tuple[_Layer, bool]]:
    """All layers that one layer unwraps to, one after the other."""
    yield from _base64_layers(layer, size, seen)
    if "%" in layer.text and (x := _rewritten(layer, _PERCENT, _percent, "url")):
        yield x, False
    if layer.path and "\x00" in layer.text and (x := _rewritten(layer, _WIDE, _wide, "wide")):
        yield x, False
    if ("\\" in layer.text or "&#" in layer.text) and (x := _rewritten(layer, _ESCAPE, _escape, "unicode")):
        yield x, False


def _find(text: str, layer_bytes: int = LAYER_BYTES) -> tuple[list[tuple[str, int, int, str]], set[tuple[int, int]]]:
    """Spans as of ``find``, and the places ``(start, end)`` of streams that were read in windows."""
    base = scan(text)
    paths: dict = {s: () for s in base}
    long: set[tuple[int, int]] = set()
    if "%" in text or "\\" in text or "&#" in text or _BASE64.search(text) or _BASE64_URL.search(text) or _WRAPPED.search(text):
        offsets = np.arange(len(text) + 1, dtype=np.int64)
        streams: dict = {}
        seen: dict = {}
        work = [_inner(_Layer(text, offsets[:-1], offsets[1:], ()), layer_bytes, streams)]
        while work:
            layer, several = next(work[-1], (None, False))
            if layer is None:
                work.pop()
                continue
            if not layer.text:
                continue
            if several:
                long.add((int(layer.starts[0]), int(layer.ends[-1])))
            key = (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), int(layer.starts[0]), int(layer.ends[-1]))
            if seen.get(key, len(layer.path) + 1) <= len(layer.path):
                continue
            seen[key] = len(layer.path)
            for kind, i, j in scan(layer.text):
                span = (kind, int(layer.starts[i]), int(layer.ends[j - 1]))
                if len(paths.get(span, (*layer.path, ""))) > len(layer.path):
                    paths[span] = layer.path
            work.append(_inner(layer, layer_bytes, streams))
    return _ordered({s: ">".join(p) for s, p in paths.items()}), long


def find(text: str, layer_bytes: int = LAYER_BYTES) -> tuple[list[tuple[str, int, int, str]], bool]:
    """Spans ``(kind, start, end, via)`` of a text and of all its layers, and whether a stream was read in windows.

    ``via`` names the decodings a span lies under, joined by ``>``, and is empty for base matches. A span that several
    layers show is listed once, with the fewest decodings. In a stream of more than ``layer_bytes`` an encoded run of
    more than a quarter of that is unwrapped in parts if it lies across two windows.
    """
    spans, long = _find(text, layer_bytes)
    return spans, bool(long)


def _ordered(spans: dict) -> list[tuple[str, int, int, str]]:
    return [(k, i, j, via) for (k, i, j), via in sorted(spans.items(), key=lambda s: (s[0][1], KINDS.index(s[0][0]), s[0][2]))]


def find_secrets(docs: DataFrame, layer_bytes: int = LAYER_BYTES) -> DataFrame:
    """``docs`` with ``secrets`` (array of kind, start, end, via) and ``secrets_cut``; columns of these names are replaced.

    Null and empty texts have none. Offsets are code points, ends exclusive. Repeated rows are scanned alike.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("secrets", "secrets_cut")
    at = docs.columns.index("text")
    schema = docs.withColumns({"secrets": F.array().cast("array<struct<kind:string,start:int,end:int,via:string>>"), "secrets_cut": F.lit(False)}).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("via", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [find(t or "", layer_bytes) for t in b.column(at).to_pylist()]
            spans = pa.array([[dict(zip(("kind", "start", "end", "via"), s, strict=True)) for s in x] for x, _ in got], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, spans, pa.array([c for _, c in got], pa.bool_())], names=[*b.schema.names, "secrets", "secrets_cut"])

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_decoded, secrets_cut)``: counts and digest of base matches, all spans, and the mark of ``find``."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    found = find_secrets(docs.select("doc_id", "text")).drop("text")
    base = F.filter("secrets", lambda s: s["via"] == "")
    counts = [F.expr(f"cast(size(filter(secrets, s -> s.via = '' AND s.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), F.size(F.filter("secrets", lambda s: s["via"] != "")).cast("long").alias("n_decoded"), "secrets_cut")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span found put out of ``text``: overlapping spans become one ``mark``; other texts stay as they are.

    Null and empty texts stay null and empty, repeated rows are treated alike, an empty table gives no rows. Runs that hold a stream read in windows are put out as well, for not all that is encoded in them need be found.
    """
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, end = [], 0
        spans, long = _find(text)
        for i, j in sorted([*((i, j) for _, i, j, _ in spans), *long]):
            if i >= end:
                out += [text[end:i], mark]
            end = max(end, j)
        return "".join((*out, text[end:])) if end else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([clean(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
