"""Constraints on which rows a selection may hold together.

A constraint sees only the label of each row: nothing for ``Uniform``, a category for ``Partition``, a list of sets for
``Transversal``. Every method takes labels in the order in which rows are tried.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from typing import Any, Protocol


class Matroid(Protocol):
    def independent(self, labels: Sequence[Any]) -> bool: ...

    def greedy(self, labels: Sequence[Any], k: int) -> list[int]: ...

    def cluster_points(self, labels: Sequence[Any], k: int) -> list[int]: ...


class Uniform:
    """At most ``cardinality`` rows."""

    def __init__(self, cardinality: int) -> None:
        self.cardinality = cardinality

    def independent(self, labels: Sequence[Any]) -> bool:
        return len(labels) <= self.cardinality

    def greedy(self, labels: Sequence[Any], k: int) -> list[int]:
        return list(range(min(len(labels), k, self.cardinality)))

    cluster_points = greedy


class Partition:
    """At most ``caps[c]`` rows of category c; a category without a cap may not occur."""

    def __init__(self, caps: Mapping[Any, int]) -> None:
        self.caps = dict(caps)

    def independent(self, labels: Sequence[Any]) -> bool:
        return all(n <= self.caps.get(c, 0) for c, n in Counter(labels).items())

    def greedy(self, labels: Sequence[Any], k: int) -> list[int]:
        held: Counter = Counter()
        out = []
        for i, c in enumerate(labels):
            if len(out) == k:
                break
            if held[c] < self.caps.get(c, 0):
                held[c] += 1
                out.append(i)
        return out

    cluster_points = greedy


class Matching:
    """A matching of rows to distinct sets that grows by augmenting paths, without recursion."""

    def __init__(self) -> None:
        self.owner: dict[Any, int] = {}
        self.sets: dict[int, Sequence[Any]] = {}

    def add(self, row: int, sets: Sequence[Any] | None) -> bool:
        """Matches one more row if that can be done; otherwise nothing changes."""
        self.sets[row] = sets or ()
        came_from: dict[Any, int] = {}
        queue = [row]
        for r in queue:
            for s in self.sets[r]:
                if s in came_from:
                    continue
                came_from[s] = r
                if s not in self.owner:
                    while True:
                        r = came_from[s]
                        before = next((t for t, o in self.owner.items() if o == r), None)
                        self.owner[s] = r
                        if r == row:
                            return True
                        s = before
                queue.append(self.owner[s])
        del self.sets[row]
        return False


class Transversal:
    """Rows that can be assigned to distinct sets among those each belongs to."""

    def independent(self, labels: Sequence[Any]) -> bool:
        m = Matching()
        return all(m.add(i, sets) for i, sets in enumerate(labels))

    def greedy(self, labels: Sequence[Any], k: int) -> list[int]:
        m, out = Matching(), []
        for i, sets in enumerate(labels):
            if len(out) == k:
                break
            if m.add(i, sets):
                out.append(i)
        return out

    def cluster_points(self, labels: Sequence[Any], k: int) -> list[int]:
        """An independent set of k rows if there is one; else, for each set that a largest one is matched to, as many rows of that set as it has rows in all."""
        order = sorted(range(len(labels)), key=lambda i: (-len(labels[i] or ()), i))
        chosen = [order[j] for j in self.greedy([labels[i] for i in order], k)]
        if len(chosen) == k:
            return chosen
        used = {s for i in chosen for s in labels[i]}
        held: Counter = Counter()
        out = set(chosen)
        for i in range(len(labels)):
            for s in labels[i] or ():
                if s in used and held[s] < len(chosen):
                    held[s] += 1
                    out.add(i)
        return sorted(out)
