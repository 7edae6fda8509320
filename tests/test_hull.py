"""Convex hulls against brute force: every plane through d points with all others on one side."""

import itertools

import numpy as np
import pytest

from simplicia.operators import hull


def plain(p):
    """volume, area, corners: supporting planes, their points hulled in the plane."""
    p = np.unique(p, axis=0)
    d = p.shape[1]
    middle, planes = p.mean(axis=0), {}
    for c in itertools.combinations(range(len(p)), d):
        q = p[list(c)]
        normal = np.array([q[1][1] - q[0][1], q[0][0] - q[1][0]]) if d == 2 else np.cross(q[1] - q[0], q[2] - q[0])
        if np.linalg.norm(normal) < 1e-12:
            continue
        normal = normal / np.linalg.norm(normal)
        side = (p - q[0]) @ normal
        if (side > 1e-9).any() and (side < -1e-9).any() or not (np.abs(side) > 1e-9).any():
            continue
        on = np.flatnonzero(np.abs(side) <= 1e-9)
        planes.setdefault(tuple(on), normal if side.min() < -1e-9 else -normal)
    volume = area = 0.0
    count = np.zeros(len(p), int)
    for on, normal in planes.items():
        q = p[list(on)]
        if d == 2:
            ends = q[np.lexsort(q.T)][[0, -1]]
            size, out = np.linalg.norm(ends[1] - ends[0]), ends
        else:
            u = q[1] - q[0]
            u = u / np.linalg.norm(u)
            flat = np.stack([(q - q[0]) @ u, (q - q[0]) @ np.cross(normal, u)], axis=1)
            size, _, _ = plain(flat)
            out = q[[i for i in range(len(q)) if is_corner(flat, i)]]
        area += size
        volume += size * abs((q[0] - middle) @ normal) / d
        for x in out:
            count[np.flatnonzero((p == x).all(axis=1))] += 1
    return volume, area, int((count >= d).sum())


def is_corner(p, i):
    """Whether a point of the plane is a corner: the directions to the others leave a gap of more than half a turn."""
    v = np.delete(p, i, axis=0) - p[i]
    a = np.sort(np.arctan2(v[:, 1], v[:, 0]))
    return np.diff(np.append(a, a[0] + 2 * np.pi)).max() > np.pi + 1e-9


rng = np.random.default_rng(5)
CLOUDS = {
    "flat2": rng.random((30, 2)), "grid2": np.array(list(itertools.product(range(4), repeat=2)), float), "line2": np.outer(np.arange(5.0), [1, 2]),
    "free3": rng.normal(size=(25, 3)), "cube3": np.array(list(itertools.product(range(3), repeat=3)), float), "ball3": (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(rng.normal(size=(40, 3))),
    "plane3": np.column_stack([rng.random((12, 2)), np.zeros(12)]), "four3": np.vstack([np.zeros(3), np.eye(3)]), "one3": np.ones((1, 3)), "twice3": np.repeat(rng.random((8, 3)), 2, axis=0),
}


@pytest.mark.parametrize("name", CLOUDS)
def test_measures(name):
    p = np.unique(CLOUDS[name], axis=0)
    if name in ("line2", "plane3", "one3"):
        assert hull.hull_measures(p) == (0.0, 0.0, 0)
        return
    want = plain(p)
    assert hull.hull_measures(p)[:2] == pytest.approx(want[:2]) and hull.hull_measures(p)[2] == want[2]


def test_blocks_are_merged(spark, monkeypatch):
    """Blocks of a few points give the same hulls as whole clouds."""
    monkeypatch.setattr(hull, "BLOCK", 12)
    rows = [(k, *map(float, x)) for k, p in CLOUDS.items() if p.shape[1] == 3 for x in p]
    got = {r["k"]: r for r in hull.hull_features(spark.createDataFrame(rows, "k string, x0 double, x1 double, x2 double"), "k", ["x0", "x1", "x2"]).collect()}
    for k, p in CLOUDS.items():
        if p.shape[1] == 3:
            v, a, c = hull.hull_measures(np.unique(p, axis=0))
            assert (got[k]["volume"], got[k]["area"], got[k]["share"]) == pytest.approx((v, a, c / len(p)))
            assert got[k]["ratio"] == pytest.approx(a / (v + 1e-12) if v else 0.0)
    empty = spark.createDataFrame([], "k string, x0 double, x1 double")
    assert hull.hull_features(empty, "k", ["x0", "x1"]).count() == 0


def test_corner_a_hair_off_a_long_edge():
    """Hundredths as in the tables: (0, 0), b and c make the least possible turn."""
    b = (50_000, 20_001)
    x = pow(b[1], -1, b[0])
    c = (b[0] - x, (1 - b[1] * x) // b[0] + b[1])  # b x c is 1
    ring = [(0, 0), (30_000, -20_000), b, c]
    assert b[0] * c[1] - b[1] * c[0] == 1
    twice = sum(p[0] * q[1] - p[1] * q[0] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))
    for order in itertools.permutations(ring):
        volume, _, corners = hull.hull_measures(np.array(order) / 100)
        assert corners == 4 and abs(volume - twice / 20_000) < 1e-8
