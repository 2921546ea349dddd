"""Selections and constraints on small arrays, against their definitions and exhaustive search."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from dispersa.functions.metrics import distances, matrix
from dispersa.operators import kernels, pairs
from dispersa.operators.matroids import Partition, Transversal, Uniform
from hypothesis import given, settings
from hypothesis import strategies as st

points_1d = st.lists(st.floats(0, 1, allow_nan=False), min_size=2, max_size=60).map(lambda v: np.array(v)[:, None])


@settings(max_examples=60, deadline=None)
@given(points_1d, st.integers(2, 20))
def test_anticover(x, k):
    chosen, radii, nearest, near = kernels.farthest(x, k)
    assert len(chosen) == len(set(chosen)) <= k
    d = matrix("euclidean", x)
    assert np.allclose(near, d[:, chosen].min(axis=1)) and (nearest == d[:, chosen].argmin(axis=1)).all()
    if len(chosen) > 1:
        assert near.max() <= kernels.edge(d[np.ix_(chosen, chosen)]) + 1e-12
    assert radii == sorted(radii, reverse=True)
    within = kernels.farthest_to_radius(x, 0.25)
    assert d[:, within].min(axis=1).max() <= 0.25 and within == sorted(within)


@settings(max_examples=40, deadline=None)
@given(points_1d, st.integers(2, 12))
def test_matching_is_greedy(x, k):
    d = matrix("euclidean", x)
    got = kernels.heaviest_pairs(d, k)
    assert len(got) == len(set(got)) == min(k, len(x))
    if len(x) > k:
        used, want = set(), []
        for _ in range(k // 2):
            _, i, j = max((d[i, j], -i, -j) for i in range(len(x)) for j in range(i + 1, len(x)) if not {i, j} & used)
            used |= {-i, -j}
            want += [-i, -j]
        assert got[: 2 * (k // 2)] == want


def test_guarantees_on_small_sets():
    rng = np.random.default_rng(1)
    for n in (6, 8, 10):
        x = rng.normal(size=(n, 3))
        d = matrix("euclidean", x)
        for k in (3, 4):
            best = {o: max(f(d[np.ix_(s, s)]) for s in itertools.combinations(range(n), k)) for o, f in kernels.OBJECTIVES.items()}
            chosen = kernels.farthest(x, k)[0]
            assert 2 * kernels.edge(d[np.ix_(chosen, chosen)]) >= best["edge"] - 1e-9
            pairs = kernels.heaviest_pairs(d, k)
            assert 3 * kernels.clique(d[np.ix_(pairs, pairs)]) >= best["clique"] - 1e-9
            local = kernels.swap_search(d, k)
            assert 2 * kernels.clique(d[np.ix_(local, local)]) >= best["clique"] - 1e-9
            found = kernels.approximate(x, k, runs=n)
            assert all(len(c) == k and v == pytest.approx(kernels.OBJECTIVES[o](d[np.ix_(c, c)])) for o, (c, v) in found.items())
            assert all(v <= best[o] + 1e-9 for o, (_, v) in found.items())


def test_local_search_is_locally_best():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 4))
    d, labels = matrix("euclidean", x), [i % 5 for i in range(30)]
    m = Partition(dict.fromkeys(range(5), 2))
    for objective in ("clique", "edge", "star"):
        s = kernels.swap_search(d, 6, 0.0, objective, m, labels)
        value = kernels.OBJECTIVES[objective](d[np.ix_(s, s)])
        assert len(s) == 6 and m.independent([labels[i] for i in s])
        for i in s:
            for j in set(range(30)) - set(s):
                t = [x for x in s if x != i] + [j]
                assert not m.independent([labels[a] for a in t]) or kernels.OBJECTIVES[objective](d[np.ix_(t, t)]) <= value + 1e-9


def test_tree_equals_kruskal():
    rng = np.random.default_rng(3)
    d = matrix("euclidean", rng.normal(size=(12, 2)))
    root, total = list(range(12)), 0.0

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for w, i, j in sorted((d[i, j], i, j) for i in range(12) for j in range(i)):
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += w
    assert kernels.tree(d) == pytest.approx(total)


def test_partition_and_uniform():
    m = Partition({"a": 2, "b": 0, "c": 1})
    assert m.independent(["a", "c", "a"]) and not m.independent(["a"] * 3) and not m.independent(["b"]) and not m.independent(["unknown"])
    assert m.greedy(["b", "a", "x", "a", "a", "c"], 9) == [1, 3, 5] and m.greedy(["a", "a", "c"], 2) == [0, 1]
    assert Uniform(2).greedy([0] * 5, 4) == [0, 1] and Uniform(5).independent([0] * 5)


def test_transversal_against_search():
    rng = random.Random(4)
    m = Transversal()
    for _ in range(300):
        sets = [rng.sample("abcde", rng.randint(0, 3)) for _ in range(rng.randint(0, 6))]
        want = any(len(set(p)) == len(p) for p in itertools.product(*sets)) if sets else True
        assert m.independent(sets) == want
        chosen = m.greedy(sets, 9)
        assert m.independent([sets[i] for i in chosen])
        rest = [i for i in range(len(sets)) if i not in chosen]
        assert not any(m.independent([sets[i] for i in [*chosen, r]]) for r in rest)
    assert not m.independent([["a"], ["b"], ["a", "b"]]) and not m.independent([None])
    assert m.cluster_points([["a"], ["a"], ["b"], ["a", "b"]], 2) == [3, 0] or len(m.cluster_points([["a"], ["a"], ["b"], ["a", "b"]], 2)) == 2
    assert m.cluster_points([["a"], ["a"], ["a"]], 2) == [0]


def test_equal_points_and_dependent_diameter():
    x = np.zeros((5, 2))
    assert kernels.farthest(x, 3)[0] == [0]
    line = np.array([[0.0], [1.0], [4.0], [9.0]])
    d = matrix("euclidean", line)
    assert kernels.diameter(d) == (0, 3, 9.0)
    assert kernels.diameter(d, Partition({"x": 1, "y": 1}), ["x", "y", "y", "x"]) == (1, 3, 8.0)
    with pytest.raises(ValueError):
        kernels.diameter(d, Partition({}), ["x"] * 4)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine_full", "cosine_half"])
def test_metric_properties(metric):
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(20, 6)))
    d = matrix(metric, x)
    assert np.allclose(d, d.T) and np.allclose(np.diag(d), 0, atol=1e-6)
    assert (d[:, :, None] <= d[:, None, :] + d.T[None] + 1e-7).all()
    if metric.startswith("cosine"):
        assert d.max() <= 1 and distances(metric, np.eye(2), np.eye(2)[0])[1] == pytest.approx(0.5 if metric == "cosine_full" else 1)
        assert np.isnan(distances(metric, np.zeros((1, 2)), np.eye(2)[0]))[0]


@pytest.mark.parametrize("metric", ["euclidean", "sq_euclidean", "cosine_full"])
def test_searches_without_matrices(metric):
    """The same rows as plain forms that hold all distances, with equal rows and draws among them."""
    rng = np.random.default_rng(7)
    for n, dim in ((1, 2), (9, 2), (150, 2), (220, 4)):
        x = np.round(rng.normal(size=(n, dim)), 1) + (0.05 if metric == "cosine_full" else 0)
        x[n // 2 : n // 2 + n // 5] = x[: n // 5]
        d = matrix(metric, x)
        radius = {"euclidean": 0.6, "sq_euclidean": 0.3, "cosine_full": 0.05}[metric]
        near, chosen = d[0].copy(), [0]
        while near.max() > radius:
            chosen.append(int(np.argmax(near)))
            near = np.minimum(near, d[chosen[-1]])
        for pool in (3, 1024):
            assert kernels.farthest_to_radius(x, radius, metric, pool=pool) == sorted(chosen)
        at, far = pairs.nearest(pairs.Blocks(metric, x, x[sorted(chosen)]))
        assert np.allclose(far, d[:, sorted(chosen)].min(axis=1)) and (metric == "cosine_full" or (at == d[:, sorted(chosen)].argmin(axis=1)).all())
        for k in (2, 5):
            assert kernels.clique_search(x, k, metric) == kernels.swap_search(d, k)


def test_large_parts_need_no_matrix():
    """A matrix of this part would take 7.2 GB; the limit is on new memory of this process."""
    import tracemalloc

    x = np.random.default_rng(2).normal(size=(30_000, 3))
    tracemalloc.start()
    assert len(kernels.clique_search(x, 4)) == 4 and len(kernels.farthest_to_radius(x, 0.5)) > 100
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
