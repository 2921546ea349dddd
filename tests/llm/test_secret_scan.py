"""Secrets that lie deep in encoded runs: long streams, odd bytes, broken lines."""

from __future__ import annotations

import base64
import bz2
import gzip
import random
import zlib

import pytest
import zstandard
from dispersa.llm import secret_scan

SECRET = "password = hunter2hunter2"
PACKERS = {"gzip": gzip.compress, "zlib": zlib.compress, "bzip2": bz2.compress, "zstd": zstandard.compress}


def coded(data: bytes) -> str:
    return base64.b64encode(data).decode().rstrip("=")


@pytest.mark.parametrize("kind", PACKERS)
def test_long_streams(spark, kind):
    """A long stream is scanned to its end, and what stands beside it is found as well."""
    pack, inner, url = PACKERS[kind], coded(SECRET.encode()), "token%3Dabcdef123"
    for tail, via in [(SECRET, ""), (inner, ">base64")]:
        run = coded(pack(pack(bytes(20 << 20) + f"\n{tail}\n".encode())))
        text, n = f"{run} {url} {inner}", len(run)
        spans, cut = secret_scan.find(text)
        assert cut
        outer = [s for s in spans if not 0 < s[1] < n]  # zstd stores what does not repeat as it is, so it shows there as well
        assert [s[:3] for s in outer] == [("assign", 0, n), ("assign", n + 1, n + 1 + len(url)), ("assign", n + 2 + len(url), len(text))]
        assert outer[0][3] == (f"base64>{kind}>{kind}{via}" if kind != "zstd" else f"base64>zstd{via}")  # the fewest decodings
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secret_scan.digest(frame).head().secrets_cut
    assert secret_scan.redact(frame).head().text == "[secret] [secret] [secret]"


@pytest.mark.parametrize("kind", PACKERS)
def test_streams_one_after_the_other(kind):
    run = coded(b"".join(PACKERS[kind](x) for x in (b"some words\n", SECRET.encode())))
    assert ("assign", 0, len(run)) in [s[:3] for s in secret_scan.find(run)[0]]


ODD = {
    "NUL padding": SECRET.encode() + bytes(100),
    "colours": b"\x1b[31m" + SECRET.encode() + b"\x1b[0m",
    "Latin-1": "Schlüssel ".encode("latin-1") + SECRET.encode(),
    "a stray byte": b"\xff " + SECRET.encode(),
    "UTF-16": f"für {SECRET}".encode("utf-16"),
    "UTF-16 big-endian": f"für {SECRET} für".encode("utf-16-be"),
    "UTF-32": SECRET.encode("utf-32"),
}


@pytest.mark.parametrize("name", ODD)
def test_bytes_that_are_not_plain_text(name):
    data = ODD[name]
    for text in (coded(data), coded(gzip.compress(data)), "".join(f"%{x:02x}" for x in data)):
        spans, cut = secret_scan.find(f"davor {text} danach")
        assert not cut and any(k == "assign" and 6 <= i < j <= 6 + len(text) for k, i, j, _ in spans)
    at = data.find(b"p")
    assert any((i, j) == (6 + 3 * at, 6 + 3 * (data.rfind(b"2") + 1)) for _, i, j, _ in spans) or name.startswith("UTF")


LONG = " ".join(f"line{i * i}" for i in range(40))
BREAKS = ["\n", "\r\n", "\n    ", " \n\t", "\\n", "\\r\\n", "\n\n"]


@pytest.mark.parametrize("columns", [5, 10, 64, 76])
@pytest.mark.parametrize("line", BREAKS)
def test_wrapped_base64(line, columns):
    for data in (f"{LONG} {SECRET} {LONG}".encode(), *(f(f"{LONG} {SECRET}".encode()) for f in PACKERS.values())):
        run = coded(data)
        run = line.join(run[i : i + columns] for i in range(0, len(run), columns))
        for before in ("key: ", "-----BEGIN DATA-----\n", "A last word\n"):
            spans, cut = secret_scan.find(before + run)
            assert not cut and any(k == "assign" and len(before) <= i < j <= len(before) + len(run) for k, i, j, _ in spans)


@pytest.mark.parametrize("before", ["x/y/", "a/", "blob_", "id-", "x", "ab", "abc", "abcd", "v1+"])
def test_base64_glued_to_what_precedes(before):
    for data in (SECRET.encode(), *(f(SECRET.encode()) for f in PACKERS.values())):
        run = coded(data)
        spans = secret_scan.find(before + run)[0]
        assert any((k, i, j) == ("assign", len(before), len(before) + len(run)) for k, i, j, _ in spans)


def test_places_in_wrapped_runs():
    run = coded(f"{'x' * 60} {SECRET}; {'y' * 60}".encode())
    text = f"davor\n\n  {run[:76]}\n  {run[76:152]}\n  {run[152:]} danach"
    first, last = 61 * 4 // 3, -(-(61 + len(SECRET)) * 4 // 3) - 1
    place = lambda k: 9 + k + 3 * (k // 76)
    assert ("assign", place(first), place(last) + 1) in [s[:3] for s in secret_scan.find(text)[0]]


def test_long_runs_take_time_in_proportion():
    assert secret_scan.find("A" * 1_000_000 + "\n" + "Ab1 " * 100_000) == ([], False)


def _encoded(kind: str, text: str, rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A text under one plain encoding, and the part of it that each character lies in."""
    if kind == "url":
        parts = ["".join(f"%{b:02X}" for b in c.encode()) if rng.random() < 0.6 or c in "%" else c for c in text]
    elif kind == "unicode":
        parts = [f"\\u{ord(c):04x}" if rng.random() < 0.6 or c in "\\" else c for c in text]
    elif kind == "entities":
        parts = [f"&#{ord(c)};" if rng.random() < 0.6 or c in "&" else c for c in text]
    else:
        data = {"base64": bytes, "gzip": gzip.compress, "zlib": zlib.compress, "bzip2": bz2.compress, "utf-16": lambda b: b.decode().encode("utf-16-le")}[kind](text.encode())
        coded = base64.b64encode(data).decode()
        if kind != "base64":
            return coded, [(0, len(coded.rstrip("=")) if kind != "utf-16" else len(coded))] * len(text)
        at = [0]
        for c in text:
            at.append(at[-1] + len(c.encode()))
        return coded, [(i * 8 // 6, -(-j * 8 // 6)) for i, j in zip(at, at[1:], strict=False)]
    ends = [0]
    for p in parts:
        ends.append(ends[-1] + len(p))
    return "".join(parts), list(zip(ends, ends[1:], strict=False))


def test_random_nestings_are_mapped_back():
    """Secrets under up to four random encodings are found, at the very characters that carry them where these are known."""
    rng = random.Random(21)
    kinds = ["url", "unicode", "entities", "base64", "gzip", "zlib", "bzip2", "utf-16"]
    for _ in range(150):
        secret = rng.choice(["password = hunter2hunter2", "AKIA" + "ABCDEFGH12345678", "token:abcdef123456", "0123456789abcdef01234567"])
        text = f"{rng.choice(['see', 'note here', ''])} {secret} {rng.choice(['and so on', 'x', ''])}"
        where = [(i, i + 1) for i in range(len(text))]
        start = text.index(secret)
        exact = True
        chain = [rng.choice(kinds) for _ in range(rng.randint(1, 4))]
        for kind in chain:
            text, places = _encoded(kind, text, rng)
            exact &= kind not in ("gzip", "zlib", "bzip2", "utf-16")
            where = [(places[i][0], places[j - 1][1]) if j > i else (i, j) for i, j in where]
        before = "Davor steht: "
        found = secret_scan.find(before + text + " danach.")[0]
        lo, hi = where[start][0] + len(before), where[start + len(secret) - 1][1] + len(before)
        near = [s for s in found if s[3] and s[1] < hi and s[2] > lo]
        assert near, (chain, text)
        if exact:
            assert any((i, j) == (lo, hi) for _, i, j, _ in near), (chain, text, near, lo, hi)
