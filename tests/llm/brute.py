"""Slow, plain versions of the corpus operators, written from their contracts alone."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def base_secrets(text: str | None) -> list[tuple[str, int, int]]:
    text, found = text or "", []
    kinds = [
        ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    ]
    for k, (name, pattern, group, least) in enumerate(kinds):
        found += [(m.start(), k, name, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return [(name, i, j) for i, _, name, j in sorted(found)]


def repeats(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(d), sum(gone), spans, sha(bytes(c for c, g in zip(d, gone, strict=True) if not g))))
    return out


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text or ""))


def contamination(texts: list[str | None], items: list[tuple], window: int = 10) -> list[tuple[int, int, int, str, bool]]:
    wanted: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        ws = words(text)
        n = min(window, len(ws))
        for k in range(len(ws) - n + 1 if n else 0):
            wanted[n][tuple(ws[k : k + n])].add(str(item))
    out = []
    for text in texts:
        ws, hit, found = words(text), set(), set()
        for n, grams in wanted.items():
            for k in range(len(ws) - n + 1):
                if (got := grams.get(tuple(ws[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= got
        out.append((len(ws), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return out


def fingerprint(text: str | None) -> int:
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows: list[tuple[int | None, int]], bits: int = 3) -> list[int | None]:
    """Smallest doc_id reachable from each (doc_id, fingerprint)."""
    distinct = sorted({f for _, f in rows})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [least.get(find(f)) for _, f in rows]


def crc(text: str) -> int:
    return zlib.crc32(text.encode())


def ogg_feature(payload: bytes, rate: int = 8000, packet: int = 8192) -> str:
    """Pages are counted from the lacing values of their packets: 255 at most to a page, the header has one of its own."""
    packets = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    pages = 1 + -(-sum(len(p) // 255 + 1 for p in packets) // 255)
    marks = len(range(0, len(payload) + rate, rate))
    crossings = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:], strict=False))
    return f"pages={pages};packets={1 + len(packets)};marks={marks};us={len(payload) * 1_000_000 // rate};sum={sum(payload)};squares={sum(x * x for x in payload)};crossings={crossings}"


def features(text: bytes) -> list[int]:
    """Numbers of bytes, pairs, hashed triples and hashed runs of five character classes."""
    kinds = [5] * 256
    for lo, hi, k in ((0x30, 0x3A, 1), (0x41, 0x5B, 2), (0x61, 0x7B, 3), (0x80, 0x100, 4)):
        kinds[lo:hi] = [k] * (hi - lo)
    for c in b" \t\r":
        kinds[c] = 0
    kinds[10] = 6
    for c in b"!#$%&*|<>{}@":
        kinds[c] = 7
    found = set(text)
    found |= {256 + (a << 8 | b) for a, b in zip(text, text[1:], strict=False)}
    found |= {256 + 65536 + (((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> 16) for a, b, c in zip(text, text[1:], text[2:], strict=False)}
    for i in range(len(text) - 4):
        run = 0
        for c in text[i : i + 5]:
            run = run << 3 | kinds[c]
        found.add(256 + 2 * 65536 + (run & 0xFFFF))
    return sorted(found)


def quality_scores(train: list[tuple[bytes, int]], texts: list[bytes]) -> list[float]:
    """Naive Bayes ratios, dual coordinate descent in the same order of steps, and the logistic curve, on dictionaries."""
    import math

    import numpy as np

    def learn(rows):
        counts = [Counter(), Counter()]
        for x, y in rows:
            counts[y].update(x)
        size = 256 + 3 * 65536
        totals = [size + sum(c.values()) for c in counts]
        ratio = {k: math.log((counts[1][k] + 1) / totals[1]) - math.log((counts[0][k] + 1) / totals[0]) for k in {*counts[0], *counts[1]}}
        absent = math.log(1 / totals[1]) - math.log(1 / totals[0])
        vectors = []
        for x, _ in rows:
            norm = math.sqrt(sum(ratio[k] ** 2 for k in x)) or 1.0
            vectors.append({k: ratio[k] / norm for k in x})
        w, bias, alpha = defaultdict(float), 0.0, [0.0] * len(rows)
        rng = np.random.default_rng(7)
        for _ in range(12):
            moved = 0.0
            for i in rng.permutation(len(rows)).tolist():
                sign = 1 if rows[i][1] else -1
                gradient = sign * (sum(w[k] * v for k, v in vectors[i].items()) + bias) - 1
                new = min(max(alpha[i] - gradient / (sum(v * v for v in vectors[i].values()) + 1), 0.0), 1.0)
                step = (new - alpha[i]) * sign
                if step:
                    for k, v in vectors[i].items():
                        w[k] += step * v
                    bias += step
                    alpha[i] = new
                    moved = max(moved, abs(step))
            if moved < 1e-3:
                break

        def margin(x):
            r = {k: ratio.get(k, absent) for k in x}
            return sum(w[k] * v for k, v in r.items() if k in w) / (math.sqrt(sum(v * v for v in r.values())) or 1.0) + bias

        return margin

    rows = [(features(t), y) for t, y in train]
    margins = [0.0] * len(rows)
    for f in range(3):
        part = learn([r for i, r in enumerate(rows) if i % 3 != f])
        for i in range(f, len(rows), 3):
            margins[i] = part(rows[i][0])
    up = sum(y for _, y in rows)
    down = len(rows) - up
    target = [(up + 1) / (up + 2) if y else 1 / (down + 2) for _, y in rows]
    a, b = 1.0, 0.0
    for _ in range(50):
        p = [1 / (1 + math.exp(-a * m - b)) for m in margins]
        g = [sum((q - t) * m for q, t, m in zip(p, target, margins, strict=True)), sum(q - t for q, t in zip(p, target, strict=True))]
        s = [q * (1 - q) for q in p]
        aa, ab, bb = sum(x * m * m for x, m in zip(s, margins, strict=True)) + 1e-6, sum(x * m for x, m in zip(s, margins, strict=True)), sum(s) + 1e-6
        det = aa * bb - ab * ab
        da, db = (bb * g[0] - ab * g[1]) / det, (aa * g[1] - ab * g[0]) / det
        a, b = a - da, b - db
        if max(abs(da), abs(db)) < 1e-6:
            break
    whole = learn(rows)
    return [1 / (1 + math.exp(-max(a, 1e-3) * whole(features(t)) - b)) for t in texts]


def spark_hash(*values: tuple[int, int]) -> int:
    """The engine's 64-bit hash of integers given with their widths in bytes, as a signed number."""
    h = 42
    for value, width in values:
        h = xxhash.xxh64_intdigest(value.to_bytes(width, "little", signed=True), seed=h)
    return h - (1 << 64) if h >> 63 else h


def propagated(groups: dict[int, list[int]], labels: dict[int, int], shards: int, rounds: int) -> tuple[dict[int, int], list[int]]:
    """Labels of rows after label propagation under quotas, and the cuts before each round."""
    room = max(1, len(labels) // shards)
    small = {g: rows for g, rows in groups.items() if 1 < len(rows) <= room}
    large = {r for g, rows in groups.items() if len(rows) > room for r in rows}
    of_row = defaultdict(list)
    for g, rows in small.items():
        for r in rows:
            of_row[r].append(g)
    now, best, cuts = dict(labels), dict(labels), []
    for turn in range(rounds + 1):
        votes = {g: Counter(now[r] for r in rows) for g, rows in small.items()}
        cut = sum(len(v) - 1 for v in votes.values())
        if cuts and cut >= cuts[-1]:
            break
        best = dict(now)
        cuts.append(cut)
        if not cut or turn == rounds:
            break
        held = Counter(now[r] for r in now if r in of_row or r in large)
        target = {}
        for r, gs in of_row.items():
            told = Counter()
            for g in gs:
                told.update(votes[g])
            scores = [told[s] * max(0.05, 1 - 0.5 * max(0.0, held[s] / room - 0.5)) + (told[s] > 0) * (spark_hash((min(gs), 8), (s, 4), (turn, 4)) % 1000) / 4000 for s in range(shards)]
            target[r] = scores.index(max(scores))
        demand = Counter((now[r], t) for r, t in target.items() if now[r] != t)
        if not demand:
            break
        share = {}
        for j in range(shards):
            inward = {i: n for (i, k), n in demand.items() if k == j}
            matched = {i: min(n, demand[j, i]) for i, n in inward.items()}
            rest = sum(inward.values()) - sum(matched.values())
            for i, n in inward.items():
                extra = (n - matched[i]) * min(1.0, max(0, room - held[j]) / rest) if rest else 0
                share[i, j] = int(1e6 * (matched[i] + extra) / n)
        for r, t in target.items():
            lot = spark_hash((min(of_row[r]), 8), (turn, 4)) % 500_000 + (500_000 if max(len(small[g]) for g in of_row[r]) * 4 > room else 0)
            if now[r] != t and lot < share[now[r], t]:
                now[r] = t
    return best, cuts
