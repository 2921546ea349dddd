"""Deep-shallow sorting of suffixes (Manzini and Ferragina, 2004).

Multikey quicksort on eight-byte symbols orders suffixes as far as a shallow depth; each group that is still equal there
shares a long prefix and is ordered by a blind trie, which compares every suffix inserted with a single other one.
"""

from __future__ import annotations

import numpy as np

SHALLOW_BYTES = 32
SMALL = 48


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by bisection over equal slices."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class BlindTrie:
    """A trie that stores branching depths and characters only; leaves hold the numbers of equal strings."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: tuple[int, dict] | list[int] | None = None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        path, node = [], self.root
        while isinstance(node, tuple):
            depth, children = node
            c = s[depth] if depth < len(s) else -1
            if c not in children:
                c = next(iter(children))
            path.append((node, c))
            node = children[c]
        other = self.strings[node[0]]
        n = common_prefix(s, other)
        if n == len(s) == len(other):
            node.append(i)
            return
        k = next((k for k, (inner, _) in enumerate(path) if inner[0] >= n), len(path))
        mine = s[n] if n < len(s) else -1
        if k < len(path) and path[k][0][0] == n:
            path[k][0][1][mine] = [i]
            return
        below = path[k][0] if k < len(path) else node
        fork = (n, {other[n] if n < len(other) else -1: below, mine: [i]})
        if k:
            inner, c = path[k - 1]
            inner[1][c] = fork
        else:
            self.root = fork

    def ordered(self) -> list[tuple[list[int], int]]:
        """Leaves in order, each with the length it has in common with the one before."""
        out: list[tuple[list[int], int]] = []
        stack = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node, list):
                out.append((node, shared))
                continue
            depth, children = node
            keys = sorted(children, reverse=True)
            stack += [(children[c], shared if c == keys[-1] else depth) for c in keys]
        return out


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and the common prefix of each in that order with the one before (0 for the first).

    A string that ends sorts before its extensions; equal strings keep their order.
    """
    n = len(strings)
    columns = -(-shallow // 8)
    width = 8 * columns
    words = np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), ">u8").reshape(n, columns).astype(np.uint64)
    done: list[np.ndarray] = []  # groups in order
    stack = [(np.arange(n), 0)]
    while stack:  # the smallest group is on top, so groups come off in order
        index, c = stack.pop()
        if len(index) < 2 or c == columns:
            done.append(index)
            continue
        key = words[index, c]
        if len(index) <= SMALL:
            ranked = sorted(index.tolist(), key=lambda i: words[i, c:].tolist())
            cut = [k for k in range(len(ranked)) if k == 0 or (words[ranked[k], c:] != words[ranked[k - 1], c:]).any()] + [len(ranked)]
            done += [np.array(ranked[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            continue
        pivot = np.partition(key[[0, len(key) // 4, len(key) // 2, 3 * len(key) // 4, -1]], 2)[2]
        below, above = key < pivot, key > pivot
        stack += [(part, d) for part, d in ((index[above], c), (index[~below & ~above], c + 1), (index[below], c)) if len(part)]
    order, shared, last = [], [], None
    for group in done:
        if len(group) == 1:
            leaves = [([int(group[0])], 0)]
        else:
            trie = BlindTrie(strings)
            for i in group.tolist():
                trie.insert(i)
            leaves = trie.ordered()
        for at, (leaf, common) in enumerate(leaves):
            own = common if at else (common_prefix(strings[last], strings[leaf[0]]) if last is not None else 0)
            order += leaf
            shared += [own] + [len(strings[leaf[0]])] * (len(leaf) - 1)
            last = leaf[-1]
    return np.array(order, np.int64), np.array(shared, np.int64)
