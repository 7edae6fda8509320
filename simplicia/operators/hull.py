"""Convex hulls of clouds in two or three dimensions: hulls of blocks, merged by cloud.

A point of a cloud's hull is a point of the hull of every block that holds it. So blocks of a cloud give up what lies inside
them, again and again while that helps, before one task sees what is left of a cloud.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplicia.sources.store import stored

#: Points of a block, on average, and the points of a cloud that one task may take without another round of blocks.
BLOCK = 512
#: Distances below this share of a cloud's extent are none.
FLAT = 1e-9
#: In two dimensions a cross product below this share of the squared extent is no turn; rounding makes less than a hundredth of it.
TURN = 1e-13


def hull_faces(p):
    """The hull of distinct points (n, d), d 2 or 3, as rows of d point numbers that face outwards, and the numbers of its
    corners; nothing for points on a line or plane."""
    import numpy as np

    n, d = p.shape
    none = np.zeros((0, d), np.int64), np.zeros(0, np.int64)
    extent = float((p.max(axis=0) - p.min(axis=0)).max()) if n else 0.0
    if n <= d or extent == 0:
        return none
    x = (p - p.mean(axis=0)) / extent

    def outward(faces):
        """Unit normals and offsets of faces, turned from the inner point."""
        if d == 2:
            e = x[faces[:, 1]] - x[faces[:, 0]]
            normal = np.stack([e[:, 1], -e[:, 0]], axis=1)
        else:
            normal = np.cross(x[faces[:, 1]] - x[faces[:, 0]], x[faces[:, 2]] - x[faces[:, 0]])
        length = np.linalg.norm(normal, axis=1)
        return normal / np.maximum(length, 1e-300)[:, None]

    # a first simplex: the farthest point each time
    corners = [int(np.argmax((x * x).sum(axis=1)))]
    base = np.zeros((0, d))
    for _ in range(d):
        rest = x - x[corners[0]]
        rest = rest - rest @ base.T @ base
        far = np.linalg.norm(rest, axis=1)
        k = int(far.argmax())
        if far[k] <= FLAT:
            return none
        corners.append(k)
        base = np.vstack([base, rest[k] / far[k]])
    inner = x[corners].mean(axis=0)

    def turned(faces):
        normal = outward(faces)
        back = ((inner - x[faces[:, 0]]) * normal).sum(axis=1) > 0
        faces[back] = faces[back][:, [1, 0, *range(2, d)]]
        normal[back] *= -1
        return faces, normal, (x[faces[:, 0]] * normal).sum(axis=1)

    faces, normal, offset = turned(np.array([[c for c in corners if c != out] for out in corners]))
    for k in np.argsort(-((x - inner) ** 2).sum(axis=1), kind="stable"):
        seen = normal @ x[k] - offset > FLAT
        if not seen.any():
            continue
        if d == 2:
            ends, times = np.unique(faces[seen], return_counts=True)
            new = np.array([[e, k] for e in ends[times == 1]])
        else:
            edges = np.sort(np.concatenate([faces[seen][:, [0, 1]], faces[seen][:, [1, 2]], faces[seen][:, [2, 0]]]), axis=1)
            ridge, times = np.unique(edges, axis=0, return_counts=True)
            new = np.column_stack([ridge[times == 1], np.full((times == 1).sum(), k)])
        new, n2, o2 = turned(new)
        faces, normal, offset = np.concatenate([faces[~seen], new]), np.concatenate([normal[~seen], n2]), np.append(offset[~seen], o2)
    # a corner's faces span all dimensions; a point inside an edge or a face of the hull is no corner
    kept = [v for v in np.unique(faces) if np.linalg.svd(normal[(faces == v).any(axis=1)], compute_uv=False)[d - 1 :].max(initial=0) > 1e-7]
    return faces, np.array(kept, np.int64)


def hull_ring(p):
    """Numbers of the corners of a hull in two dimensions, around it; nothing for points on a line. Turns are told by cross products
    of the coordinates as they are, down to TURN of the squared extent, so a corner that lies a hair off a long edge stays."""
    import numpy as np

    order = np.lexsort((p[:, 1], p[:, 0]))
    x, y = p[:, 0].tolist(), p[:, 1].tolist()
    flat = TURN * float((p.max(axis=0) - p.min(axis=0)).max()) ** 2 if len(p) else 0.0

    def half(points):
        out = []
        for c in points:
            while len(out) > 1:
                a, b = out[-2], out[-1]
                if (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a]) > flat:
                    break
                out.pop()
            out.append(c)
        return out[:-1]

    ring = half(order.tolist()) + half(order[::-1].tolist())
    return np.array(ring if len(ring) > 2 else [], np.int64)


def hull_measures(p):
    """volume, area (in two dimensions: area and perimeter) and number of corners; zeros for flat clouds."""
    import numpy as np

    if p.shape[1] == 2:
        ring = p[hull_ring(p)]
        if not len(ring):
            return 0.0, 0.0, 0
        q = ring - ring[0]
        step = np.roll(q, -1, axis=0)
        return abs(math.fsum(q[:, 0] * step[:, 1] - q[:, 1] * step[:, 0])) / 2, math.fsum(np.sqrt(((step - q) ** 2).sum(axis=1))), len(ring)
    faces, corners = hull_faces(p)
    if not len(faces):
        return 0.0, 0.0, 0
    q = p[faces] - p[corners[0]]
    side = np.cross(q[:, 1] - q[:, 0], q[:, 2] - q[:, 0])
    return float(np.abs(np.einsum("ij,ij->i", q[:, 0], side)).sum() / 6), float(np.linalg.norm(side, axis=1).sum() / 2), len(corners)


def hull_features(cloud: DataFrame, key: str, coordinates: list[str]) -> DataFrame:
    """key, volume, area, ratio (area over volume) and share (corners of the hull among all points) of every cloud; zeros for
    clouds on a line or plane. In two dimensions volume is the area and area the perimeter."""
    kind = dict(cloud.dtypes)[key]
    points = f"{key} {kind}, " + ", ".join(f"{c} double" for c in coordinates)

    def corners(f):
        p = f[coordinates].to_numpy(float)
        kept = hull_ring(p) if p.shape[1] == 2 else hull_faces(p)[1]
        return (f.iloc[kept] if len(kept) else f)[[key, *coordinates]]  # a flat block keeps all its points

    def measures(f):
        import pandas as pd

        return pd.DataFrame([(f[key].iloc[0], *hull_measures(f[coordinates].to_numpy(float)))], columns=[key, "volume", "area", "corners"])

    cloud = cloud.select(key, *(F.col(c).cast("double").alias(c) for c in coordinates))
    sizes = cloud.groupBy(key).agg(F.count("*").alias("n"))
    left = stored(cloud.distinct(), "hull")
    while True:
        held = left.groupBy(key).agg(F.count("*").alias("_n"))
        most, total = held.agg(F.max("_n"), F.sum("_n")).collect()[0]
        if (most or 0) <= BLOCK:
            break
        block = F.pmod(F.xxhash64(*coordinates), F.ceil(F.col("_n") / BLOCK)).alias("_block")
        fewer = stored(left.join(held, key).select(key, block, *coordinates).groupBy(key, "_block").applyInPandas(corners, points), "hull")
        shrunk = fewer.count() < 0.9 * total
        left = fewer
        if not shrunk:
            break
    got = left.groupBy(key).applyInPandas(measures, f"{key} {kind}, volume double, area double, corners long")
    return got.join(sizes, key).select(key, "volume", "area", F.when(F.col("volume") > 0, F.col("area") / (F.col("volume") + 1e-12)).otherwise(0.0).alias("ratio"), (F.col("corners") / F.col("n")).alias("share"))
