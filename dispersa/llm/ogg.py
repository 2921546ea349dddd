"""Ogg containers in binary columns, from the public page format (RFC 3533): pages, lacing, logical streams, granules.

Payloads are kept as uncompressed 8-bit samples in a logical stream with an OggPCM header; a second logical stream holds
one marker for each second of samples. Reading verifies every page's checksum and sequence number, rebuilds packets from
lacing values across pages, separates streams by serial number and derives times from granule positions.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_bytes

PAD = 64
RATE = 8000
PACKET_BYTES = 8192
SAMPLES, MARKS = 0x53414D50, 0x4D41524B
_HEADER = struct.Struct("<4sBBqIIIB")
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """The checksum of a page whose checksum field is zero: polynomial 0x04c11db7, most significant bit first, no inversion.

    The usual CRC-32 runs over the same polynomial from the other end of each byte, so mirrored bytes go in and a mirrored sum comes out.
    """
    return int(f"{zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", page_crc(head + body)) + head[26:] + body


def write_stream(serial: int, packets: list[tuple[bytes, int]], header_packets: int = 1) -> list[tuple[int, bytes]]:
    """Pages ``(granule, page)`` of a logical stream; each packet comes with the granule at its end.

    The first packet has a page of its own, and no data packet shares one with a header. A packet longer than what is
    left of a page goes on in the next.
    """
    pages: list[tuple[int, int, bytes, bytes]] = []
    lacing, body, granule, continued = bytearray(), bytearray(), -1, 0
    starts_continued = 0

    def flush() -> None:
        nonlocal lacing, body, granule, starts_continued
        pages.append((starts_continued, granule, bytes(lacing), bytes(body)))
        lacing, body, granule, starts_continued = bytearray(), bytearray(), -1, continued

    for k, (data, end) in enumerate(packets):
        values = b"\xff" * (len(data) // 255) + bytes((len(data) % 255,))
        at = 0
        while at < len(values):
            room = 255 - len(lacing)
            part = values[at : at + room]
            done = at + len(part) == len(values)
            body += data[at * 255 : len(data) if done else (at + len(part)) * 255]
            lacing += part
            at += len(part)
            continued = 0 if done else _CONTINUED
            if done:
                granule = end
            if len(lacing) == 255:
                flush()
        if k < header_packets and lacing:
            flush()
    if lacing or not pages:
        flush()
    last = len(pages) - 1
    return [(g, _page(c | (_FIRST if i == 0 else 0) | (_LAST if i == last else 0), g, serial, i, lace, b)) for i, (c, g, lace, b) in enumerate(pages)]


def mux(streams: list[list[tuple[int, bytes]]]) -> bytes:
    """One physical stream: all first pages, then pages by granule, each stream's in order."""
    rest = []
    for s, pages in enumerate(streams):
        reached = 0
        for i, (granule, page) in enumerate(pages[1:]):
            reached = max(reached, granule)
            rest.append((reached, s, i, page))
    return b"".join([pages[0][1] for pages in streams] + [page for *_, page in sorted(rest, key=lambda x: x[:3])])


@dataclass
class LogicalStream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of each page that ends a packet
    ended_by: list[int] = field(default_factory=list)  # packets done by then
    pages: int = 0
    ended: bool = False
    _open: bytearray = field(default_factory=bytearray)
    _in_packet: bool = False


def demux(data: bytes) -> dict[int, LogicalStream]:
    """The logical streams of a physical stream by serial number; ValueError for damage of any kind."""
    streams: dict[int, LogicalStream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < _HEADER.size:
            raise ValueError("cut within a page header")
        magic, version, flags, granule, serial, number, crc, n = _HEADER.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        lacing = data[at + 27 : at + 27 + n]
        begin = at + 27 + n
        end = begin + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise ValueError("cut within a page")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at byte {at}")
        if bool(flags & _FIRST) == (serial in streams):
            raise ValueError("a stream starts twice or not at all")
        s = streams.setdefault(serial, LogicalStream())
        if number != s.pages or s.ended or bool(flags & _CONTINUED) != s._in_packet:
            raise ValueError("pages of a stream are missing or out of order")
        done = len(s.packets)
        size = 0
        for value in lacing:
            size += value
            if value < 255:
                packet = data[begin : begin + size]
                s.packets.append(bytes(s._open) + packet if s._open else packet)
                s._open.clear()
                begin += size
                size, s._in_packet = 0, False
        if n and lacing[-1] == 255:
            s._open += data[begin : begin + size]
            s._in_packet = True
        if len(s.packets) > done:
            s.granules.append(granule)
            s.ended_by.append(len(s.packets))
        s.pages += 1
        s.ended = bool(flags & _LAST)
        at = end
    if any(s._in_packet or not s.ended for s in streams.values()):
        raise ValueError("a stream does not end")
    return streams


def store(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit unsigned mono samples as a physical stream of two logical streams."""
    head = b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, rate, 8, 1, 0, 0)
    samples = [(head, 0)] + [(payload[i : i + PACKET_BYTES], min(i + PACKET_BYTES, len(payload))) for i in range(0, len(payload), PACKET_BYTES)]
    marks = [(b"MARK" + struct.pack("<I", rate), 0)] + [(struct.pack("<Q", i), min(i, len(payload))) for i in range(0, len(payload) + rate, rate)]
    return mux([write_stream(SAMPLES, samples), write_stream(MARKS, marks)])


@dataclass
class Media:
    samples: bytes
    rate: int
    streams: dict[int, LogicalStream]

    def seconds(self, serial: int = SAMPLES) -> list[float]:
        """The time at the end of each page that ends a packet."""
        return [g / self.rate for g in self.streams[serial].granules]


def load(data: bytes) -> Media:
    """What ``store`` wrote, read back and checked."""
    streams = demux(data)
    if SAMPLES not in streams or not streams[SAMPLES].packets[0].startswith(b"PCM     "):
        raise ValueError("no stream of samples")
    own = streams[SAMPLES]
    samples = b"".join(own.packets[1:])
    if own.granules[-1] != len(samples):
        raise ValueError("the last granule does not count the samples")
    return Media(samples, struct.unpack_from(">I", own.packets[0], 16)[0], streams)


def feature(media: Media) -> str:
    """Page and packet counts, duration in microseconds, mean, root mean square and zero crossings around 128."""
    own = media.streams[SAMPLES]
    x = np.frombuffer(media.samples, np.uint8)
    high = x >= 128
    total, squares = int(x.sum(dtype=np.int64)), int((x.astype(np.int32) ** 2).sum(dtype=np.int64))
    return f"pages={own.pages};packets={len(own.packets)};marks={len(media.streams[MARKS].packets) - 1};us={own.granules[-1] * 1_000_000 // media.rate};sum={total};squares={squares};crossings={int((high[1:] != high[:-1]).sum())}"


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % PAD if data else PAD)


def store_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with binary ``media``, the text's padded UTF-8 bytes as an Ogg file; a column of that name is replaced.

    A null text counts as empty; equal texts have equal files, repeated rows included; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("media")
    at = docs.columns.index("text")
    schema = docs.withColumn("media", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [store(padded((t or "").encode())) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(media, pa.binary())], names=[*b.schema.names, "media"])

    return docs.mapInArrow(run, schema)


def load_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with ``payload``, ``media_seconds``, ``media_feature`` and ``media_error`` read from binary ``media``; columns of these names are replaced.

    A file that is damaged, or no file of ``store_documents``, has null in the first three and in ``media_error`` what is
    wrong with it; a null one has ``null``. Whole files have null there. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("payload", "media_seconds", "media_feature", "media_error")
    at = docs.columns.index("media")
    added = {"payload": ("binary", pa.binary()), "media_seconds": ("double", pa.float64()), "media_feature": ("string", pa.string()), "media_error": ("string", pa.string())}
    schema = docs.withColumns({c: F.lit(None).cast(kind) for c, (kind, _) in added.items()}).schema

    def row(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, "null"
        try:
            media = load(data)
            return media.samples, len(media.samples) / media.rate, feature(media), None
        except (ValueError, KeyError, IndexError, ZeroDivisionError, struct.error) as e:
            return None, None, None, str(e) or type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = zip(*map(row, b.column(at).to_pylist()), strict=True) if b.num_rows else [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, kind) for c, (_, kind) in zip(columns, added.values(), strict=True))], names=[*b.schema.names, *added])

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Stores every text, reads the stored column back, and returns sizes, digests and features of what was read.

    Rows of equal texts are equal but for doc_id; null texts count as empty; an empty table gives no rows.
    """
    stored = store_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    read = load_documents(stored.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "media"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -PAD, PAD)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("media_feature").alias("feature"),
    )
