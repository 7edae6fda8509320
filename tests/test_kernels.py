"""Kernels against cases with known answers and a full boundary reduction."""

from itertools import combinations

import numpy as np
import pytest

from simplicia.functions import kernels as K


def reduced(d, maxdim):
    """Diagrams by textbook reduction of the whole boundary matrix."""
    simplices = sorted((max((d[a, b] for a, b in combinations(c, 2)), default=0.0), k, c) for k in range(maxdim + 2) for c in combinations(range(len(d)), k + 1))
    at = {s[2]: i for i, s in enumerate(simplices)}
    low, columns, out, born = {}, {}, [[] for _ in range(maxdim + 1)], set()
    for j, (v, k, c) in enumerate(simplices):
        col = {at[c[:i] + c[i + 1 :]] for i in range(len(c))} if k else set()
        while col and max(col) in low:
            col ^= columns[low[max(col)]]
        if not col:
            born.add(j)
            continue
        m = max(col)
        low[m], columns[j] = j, col
        born.discard(m)
        if simplices[m][1] <= maxdim and v > simplices[m][0]:
            out[simplices[m][1]].append((simplices[m][0], v))
    for j in born:
        if simplices[j][1] <= maxdim:
            out[simplices[j][1]].append((simplices[j][0], np.inf))
    return [sorted(x) for x in out]


def test_square_has_one_loop():
    d = K.distances([[0, 0], [1, 0], [1, 1], [0, 1]])
    assert np.allclose(K.rips(d, 1)[1], [[1, np.sqrt(2)]])


@pytest.mark.parametrize("n", [5, 6, 7, 8, 12])
def test_polygons(n):
    a = 2 * np.pi * np.arange(n) / n
    got = K.rips(K.distances(np.c_[np.cos(a), np.sin(a)]), 1)[1]
    assert np.allclose(got, [[2 * np.sin(np.pi / n), 2 * np.sin(np.pi * np.ceil(n / 3) / n)]])


def test_octahedron_and_line():
    o = K.rips(K.distances(np.r_[np.eye(3), -np.eye(3)]), 2)
    assert len(o[1]) == 0 and np.allclose(o[2], [[np.sqrt(2), 2]])
    line = K.rips(K.distances(np.arange(6.0)[:, None]), 1)
    assert len(line[1]) == 0 and np.allclose(line[0][:-1], [[0, 1]] * 5) and np.isinf(line[0][-1, 1])


@pytest.mark.parametrize("seed", range(6))
def test_against_full_reduction(seed):
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(12, 3)) if seed % 2 else rng.integers(0, 3, (11, 2)).astype(float)  # the second kind has ties
    d = K.distances(p)
    for got, want in zip(K.rips(d, 2), reduced(d, 2), strict=True):
        assert np.allclose(np.nan_to_num(np.array(sorted(map(tuple, got))).reshape(-1, 2), posinf=-1), np.nan_to_num(np.array(want).reshape(-1, 2), posinf=-1))


def test_rotation_and_stability():
    rng = np.random.default_rng(5)
    p = rng.normal(size=(25, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    a, b = K.rips(K.distances(p), 1)[1], K.rips(K.distances(p @ q), 1)[1]
    assert np.allclose(a, b)
    shift = rng.uniform(-0.01, 0.01, p.shape)
    c = K.rips(K.distances(p + shift), 1)[1]
    assert K.bottleneck(a, c) <= 2 * np.sqrt((shift**2).sum(1)).max() + 1e-9


def test_tiny_clouds():
    assert K.rips(np.zeros((1, 1)), 1)[0].tolist() == [[0.0, np.inf]]
    assert K.rips(K.distances([[0.0], [3.0]]), 1)[0].tolist() == [[0.0, 3.0], [0.0, np.inf]]


def test_distances_of_diagrams():
    a, b = [[0, 2.0]], [[0, 3.0]]
    assert K.wasserstein(a, b) == pytest.approx(1.0) and K.bottleneck(a, b) == pytest.approx(1.0)
    assert K.wasserstein(a, []) == pytest.approx(2 / np.sqrt(2)) and K.bottleneck(a, []) == pytest.approx(1.0)
    assert K.wasserstein([], []) == 0 and K.bottleneck([], [[1, np.inf]]) == 0
    rng = np.random.default_rng(0)
    cost = rng.random((6, 6))
    from itertools import permutations

    assert K.assignment(cost)[1] == pytest.approx(min(sum(cost[i, p[i]] for i in range(6)) for p in permutations(range(6))))


def test_image_mass_and_pvalues():
    img = K.persistence_image([[1, 3.0]], (0, 4), (0, 4), 20, 0.1)
    assert img.sum() == pytest.approx(2.0, rel=1e-3)
    assert K.t_pvalue(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert K.wilcoxon_pvalue([1, 2, 3, 4, 5, 6]) == pytest.approx(2 / 64)


def test_distances_of_components_by_sorting():
    """Bars born at once take no matching; the general kernels give the same."""
    import time

    from simplicia.functions import kernels as k

    rng = np.random.default_rng(3)
    for trial in range(150):
        birth = float(trial % 3)
        a, b = (np.column_stack([np.full(n, birth), birth + rng.choice([1, 10, 100]) * rng.random(n).round(trial % 4)]) for n in rng.integers(0, 9, 2))
        if len(a) + len(b) == 0:
            continue
        for order in (1.0, 2.0):
            assert abs(k.wasserstein(a, b, order) - k._wasserstein_plane(a, b, order)) < 1e-6
        assert abs(k.bottleneck(a, b) - k._bottleneck_plane(a, b)) < 1e-12
    many = lambda: np.column_stack([np.zeros(1500), rng.random(1500)])
    start = time.perf_counter()
    assert k.wasserstein(many(), many()) > 0 and k.bottleneck(many(), many()) > 0
    assert time.perf_counter() - start < 5  # minutes by assignment


def test_apparent_pairs_are_told_in_one_go(monkeypatch):
    """Facets are looked at one by one for the few columns that are reduced, not for every simplex; with ties as without."""
    rng, plain, calls = np.random.default_rng(4), K._latest_facet, []
    monkeypatch.setattr(K, "_latest_facet", lambda d, s: calls.append(s) or plain(d, s))
    K.rips(K.distances(rng.random((40, 3))), 2)
    assert len(calls) < 1000  # of more than 5,000 triangles
    for points in (rng.random((12, 3)), rng.integers(0, 3, (12, 3)).astype(float)):
        d = K.distances(points)
        for size in (3, 4):
            simplices = np.array([rng.permutation(c) for c in combinations(range(12), size)])
            removed = K._removed_from_latest(d, simplices)
            assert all(set(plain(d, tuple(s))[1]) == set(s) - {r} for s, r in zip(simplices.tolist(), removed.tolist(), strict=True))
