"""Dense numerical kernels, each a deterministic function of one cloud, diagram or small matrix.

They run inside Arrow batches; Spark deals out the clouds. Nothing here touches a session.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np

#: Simplices a single cloud may ask for; beyond it the cloud must be subsampled first.
MAX_SIMPLICES = 30_000_000


def distances(points) -> np.ndarray:
    """Euclidean distance matrix."""
    p = np.asarray(points, float)
    return np.sqrt(np.maximum(((p[:, None, :] - p[None, :, :]) ** 2).sum(-1), 0))


def measure_weights(d: np.ndarray, k: int = 5) -> np.ndarray:
    """Distance to measure of each point: its mean distance to the k nearest others (all, if there are fewer)."""
    n = len(d)
    others = d + np.where(np.eye(n, dtype=bool), np.inf, 0.0)
    return np.sort(np.partition(others, min(k, n - 1) - 1, axis=1)[:, : min(k, n - 1)], axis=1).mean(1)


def shape_weights(d: np.ndarray) -> np.ndarray:
    """tanh(0.5 mean + 0.3 sd - 0.2 least above 0) of each point's distances, itself included."""
    n = len(d)
    mean = d.sum(1) / n
    sd = np.sqrt(np.maximum((d * d).sum(1) / n - mean * mean, 0))
    least = np.where(d > 0, d, np.inf).min(1)
    return np.tanh(0.5 * mean + 0.3 * sd - 0.2 * np.where(np.isfinite(least), least, 0.0))


def weighted(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Distances of the weighted filtration: (d + w_i + w_j) / 2, zeros on the diagonal. Each pair is summed in one order, as the
    other direction may round otherwise."""
    out = np.triu((d + w[:, None] + w[None, :]) / 2, 1)
    return out + out.T


def mst_weights(d: np.ndarray) -> np.ndarray:
    """Sorted edge weights of a minimum spanning tree, the finite deaths of H0."""
    n = len(d)
    if n < 2:
        return np.zeros(0)
    best, inside, out = d[0].copy(), np.zeros(n, bool), np.empty(n - 1)
    inside[0] = True
    best[0] = np.inf
    for k in range(n - 1):
        i = int(np.argmin(best))
        out[k] = best[i]
        inside[i] = True
        best = np.minimum(best, d[i])
        best[inside] = np.inf
    return np.sort(out)


def _spanning(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the edges of the spanning tree of least keys, none of which are equal, so it is the one that filtration order gives."""
    n = len(keys)
    best, via, inside = keys[0].copy(), np.zeros(n, np.int64), np.zeros(n, bool)
    a, b, most = np.empty(n - 1, np.int64), np.empty(n - 1, np.int64), np.iinfo(np.int64).max
    inside[0], best[0] = True, most
    for k in range(n - 1):
        j = int(best.argmin())
        a[k], b[k] = via[j], j
        inside[j] = True
        row = keys[j]
        nearer = row < best
        best[nearer], via[nearer] = row[nearer], j
        best[inside] = most
    return np.minimum(a, b), np.maximum(a, b)


def rips(d: np.ndarray, maxdim: int = 1) -> list[np.ndarray]:
    """Vietoris-Rips persistence diagrams over Z/2 up to maxdim: one array (birth, death) for each dimension, without
    bars of length zero; the last component never dies.

    Cohomology: simplices as columns, latest first; a column's pivot is its earliest cofacet. A simplex and its
    earliest cofacet whose latest facet it is form an apparent pair and are never reduced; vectorised, this leaves a
    few columns. Beyond the enclosing radius the complex is a cone, so simplices are cut there. Distances go by their
    ranks, small integers that compare alike; a simplex is one number, its rank before its descending vertices.

    Loops are bounded by the numbers of their cofacets, 63 bits, at 7,131 points. From dimension two on all simplices of the dimension are held, so there
    MAX_SIMPLICES bounds the cloud.
    """
    d = np.asarray(d, float)
    n = len(d)
    if maxdim < 1 or n < 3:
        h0 = np.array([(0.0, w) for w in mst_weights(d) if w > 0] + [(0.0, np.inf)] * bool(n)).reshape(-1, 2)
        return [h0] + [np.zeros((0, 2))] * maxdim
    if maxdim > 1 and math.comb(n, maxdim + 1) * n > MAX_SIMPLICES * 8 or n ** (maxdim + 4) // 2 >= 1 << 63:
        raise ValueError(f"{n} points in dimension {maxdim} are too many for one cloud: subsample or lower maxdim")
    values, rank = np.unique(d, return_inverse=True)
    if (d != d.T).any():
        raise ValueError("distances differ by direction")
    limit = int(np.searchsorted(values, d.max(1).min()))
    small = np.int16 if len(values) < 1 << 15 else np.int32
    rank = rank.reshape(n, n).astype(small)
    np.fill_diagonal(rank, len(values))  # no simplex grows by a vertex of its own
    at = np.arange(n)
    keys = rank.astype(np.int64) * n * n + np.maximum(at[:, None], at) * n + np.minimum(at[:, None], at)
    a, b = _spanning(keys)
    merged = np.sort(d[a, b])
    diagrams = [np.array([(0.0, w) for w in merged if w > 0] + [(0.0, np.inf)]).reshape(-1, 2)]
    later, earlier = np.tril_indices(n, -1)
    simplices = np.column_stack([earlier, later])[rank[earlier, later] <= limit]
    cleared = np.sort(b * n + a)
    for dim in range(1, maxdim + 1):
        pairs, cleared = _reduce(rank, simplices, cleared, limit)
        bars = np.append(values, np.inf)[pairs]
        diagrams.append(bars[np.lexsort((bars[:, 1], bars[:, 0]))])
        if dim < maxdim:
            held = _held(n)
            simplices = np.concatenate([_grown(rank, simplices[at : at + held], limit) for at in range(0, len(simplices), held)] or [np.zeros((0, dim + 2), int)])
    return diagrams


def _held(n: int) -> int:
    """Simplices that are looked at at once, with all their cofacets."""
    return max(1, 250_000 // n)


def _reach(rank: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The largest rank between each simplex and every vertex."""
    out = rank.take(part[:, 0], axis=0)
    for k in range(1, part.shape[1]):
        np.maximum(out, rank.take(part[:, k], axis=0), out=out)
    return out


def _grown(rank: np.ndarray, part: np.ndarray, limit: int) -> np.ndarray:
    """Each simplex (its vertices ascend) with every later vertex that lies within the limit of all its own."""
    at, v = np.nonzero((_reach(rank, part) <= limit) & (np.arange(len(rank)) > part[:, -1:]))
    return np.column_stack([part[at], v])


def _codes(ascending: np.ndarray, n: int) -> np.ndarray:
    """One number for each simplex, by its vertices from the last one on."""
    code = np.zeros(len(ascending), np.int64)
    for v in ascending.T[::-1]:
        code = code * n + v
    return code


def _among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each code is one of the known ones, which are sorted."""
    if not len(known):
        return np.zeros(len(codes), bool)
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


def _latest_facet(rank: np.ndarray, simplex: tuple[int, ...]) -> tuple:
    """Diameter and descending vertices of the facet of a simplex (vertices in any order) that comes last in the filtration."""
    facets = [tuple(sorted(simplex[:i] + simplex[i + 1 :], reverse=True)) for i in range(len(simplex))]
    return max((max(rank[a, b] for a, b in combinations(f, 2)), f) for f in facets)


def _removed_from_latest(rank: np.ndarray, simplices: np.ndarray) -> np.ndarray:
    """The vertex of each simplex that its latest facet lacks: of the facets of largest diameter that without the
    smallest vertex, as descending vertices compare in filtration order."""
    ascending = np.sort(simplices, axis=1)
    size = ascending.shape[1]
    sides = {(a, b): rank[ascending[:, a], ascending[:, b]] for a, b in combinations(range(size), 2)}
    facets = np.stack([reduce(np.maximum, [x for ends, x in sides.items() if i not in ends]) for i in range(size)], axis=1)
    return ascending[np.arange(len(ascending)), facets.argmax(1)]


def _reduce(rank: np.ndarray, simplices: np.ndarray, cleared: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the bars of one dimension (-1: never dies) and the pivots, which need no column in the next, as sorted codes."""
    n, size = len(rank), simplices.shape[1]
    top = n ** (size + 1)
    apparent, rows = [np.zeros(0, np.int64)], []
    held = _held(n)
    for start in range(0, len(simplices), held):
        part = simplices[start : start + held]
        code = _codes(part, n)
        keep = ~_among(code, cleared)
        part, code = part[keep], code[keep]
        if not len(part):
            continue
        diameter = reduce(np.maximum, [rank[part[:, a], part[:, b]] for a, b in combinations(range(size), 2)])
        reach = np.maximum(_reach(rank, part), diameter[:, None])
        first = reach.argmin(1)
        low = reach[np.arange(len(part)), first]
        near = np.flatnonzero((low <= limit) & (low == diameter))
        cofacets = np.sort(np.column_stack([part[near], first[near]]), axis=1)
        alike = _removed_from_latest(rank, cofacets) == first[near] if len(near) else np.zeros(0, bool)
        apparent.append(_codes(cofacets[alike], n))  # apparent pairs, of length zero
        left = np.ones(len(part), bool)
        left[near[alike]] = False
        rows.append(diameter[left].astype(np.int64) * n**size + code[left])
    codes = np.sort(np.concatenate(apparent))
    columns = np.sort(np.concatenate(rows))[::-1].tolist() if rows else []
    powers = [n**k for k in range(size + 2)]
    everyone = np.arange(n, dtype=np.int64)
    known_cofacets: dict[int, list[int]] = {}

    def cofacets_of(simplex: int) -> list[int]:
        """Numbers of the cofacets within the limit."""
        found = known_cofacets.get(simplex)
        if found is None:
            diameter, code = divmod(simplex, powers[size])
            vertices = [code // powers[k] % n for k in range(size - 1, -1, -1)]
            reach = rank[vertices[0]]
            for v in vertices[1:]:
                reach = np.maximum(reach, rank[v])
            grown = np.empty(n, np.int64)
            above = n
            for k in range(size + 1):  # the vertex comes behind the first k of the simplex
                below = vertices[k] if k < size else -1
                rest = sum(v * powers[size - at - (at >= k)] for at, v in enumerate(vertices))
                grown[below + 1 : above] = everyone[below + 1 : above] * powers[size - k] + rest
                above = below
            within = reach <= limit
            within[vertices] = False
            found = (np.maximum(reach[within], diameter).astype(np.int64) * top + grown[within]).tolist()
            if len(known_cofacets) * n > 2_000_000:
                known_cofacets.clear()
            known_cofacets[simplex] = found
        return found

    bars: list[tuple[int, int]] = []
    pivots: dict[int, list[int]] = {}
    paired = set(codes.tolist()) if len(codes) < 100_000 else None
    for key in columns:
        column, made, low = set(cofacets_of(key)), [key], -1
        while column:
            low = min(column)
            known = pivots.get(low)
            if known is None and (low % top in paired if paired is not None else bool(_among(np.array([low % top]), codes)[0])):
                diameter, face = _latest_facet(rank, tuple(low % top // powers[k] % n for k in range(size, -1, -1)))
                face = int(diameter) * powers[size] + sum(v * powers[size - 1 - k] for k, v in enumerate(face))
                known = [face] if face != key else None
            if known is None:
                break
            for s in known:
                column ^= set(cofacets_of(s))
            made.extend(known)
        dia = key // powers[size]
        if not column:
            bars.append((dia, -1))
            continue
        odd: dict[int, int] = {}
        for s in made:
            odd[s] = odd.get(s, 0) ^ 1
        pivots[low] = [s for s, k in odd.items() if k]
        if low // top > dia:
            bars.append((dia, low // top))
    return np.array(bars, np.int64).reshape(-1, 2), np.sort(np.append(codes, np.array([low % top for low in pivots], np.int64)))


def assignment(cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Column of each row in a cheapest perfect matching of a square matrix, and its cost (shortest augmenting
    paths with potentials)."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, -1)
    for row in range(n):
        match[n] = row
        at, slack, came, used = n, np.full(n + 1, np.inf), np.full(n + 1, n), np.zeros(n + 1, bool)
        while match[at] >= 0:
            used[at] = True
            free = np.flatnonzero(~used[:n])
            reduced = cost[match[at], free] - u[match[at]] - v[free]
            better = reduced < slack[free]
            slack[free[better]] = reduced[better]
            came[free[better]] = at
            nxt = int(free[np.argmin(slack[free])])
            step = slack[nxt]
            u[match[used]] += step
            v[used] -= step
            slack[free] -= step
            at = nxt
        while at != n:
            match[at] = match[came[at]]
            at = int(came[at])
    columns = np.empty(n, int)
    columns[match[:n]] = np.arange(n)
    return columns, float(cost[np.arange(n), columns].sum())


def _finite(diagram) -> np.ndarray:
    p = np.asarray(diagram, float).reshape(-1, 2)
    return p[np.isfinite(p).all(1)]


def _one_birth(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all bars are born at once, as components are: then they are numbers on a line."""
    births = np.concatenate([a[:, 0], b[:, 0]])
    return bool((births == births[0]).all()) and bool((np.concatenate([a[:, 1], b[:, 1]]) >= births[0]).all())


def _wasserstein_line(a: np.ndarray, b: np.ndarray, order: float) -> float:
    """On a line a cheapest matching doesn't cross, so prefixes of the sorted deaths give it row by row."""
    a, b = a[np.argsort(a[:, 1])], b[np.argsort(b[:, 1])]
    alone = lambda x: ((x[:, 1] - x[:, 0]) / math.sqrt(2)) ** order
    spent = np.append(0.0, np.cumsum(alone(b)))
    best = spent.copy()
    for death, out in zip(a[:, 1].tolist(), alone(a).tolist(), strict=True):
        reached = best + out
        np.minimum(reached[1:], best[:-1] + np.abs(death - b[:, 1]) ** order, out=reached[1:])
        best = spent + np.minimum.accumulate(reached - spent)
    return float(max(best[-1], 0.0)) ** (1 / order)


def _bottleneck_line(a: np.ndarray, b: np.ndarray) -> float:
    """On a line the k longest bars of either side meet in order, for the best k, and the others go to the diagonal: a longer bar
    takes a shorter one's partner at no greater cost, unless that partner is as well off at the diagonal."""
    x, y = np.sort(a[:, 1])[::-1], np.sort(b[:, 1])[::-1]
    k = min(len(x), len(y))
    met = np.append(0.0, np.maximum.accumulate(np.abs(x[:k] - y[:k])))
    half = lambda v: np.append((v - a[0, 0] if len(a) else v - b[0, 0]) / 2, np.zeros(1))[: k + 1]
    return float(np.maximum(met, np.maximum(half(x), half(y))).min())


def wasserstein(a, b, order: float = 1.0) -> float:
    """Wasserstein distance of two diagrams with Euclidean ground cost; a bar may go to the diagonal."""
    a, b = _finite(a), _finite(b)
    n, m = len(a), len(b)
    if n + m == 0:
        return 0.0
    if order >= 1 and _one_birth(a, b):
        return _wasserstein_line(a, b, order)
    return _wasserstein_plane(a, b, order)


def _wasserstein_plane(a: np.ndarray, b: np.ndarray, order: float) -> float:
    """Bars that gain nothing from each other go to the diagonal in some cheapest matching; the others fall apart into groups that are
    matched one by one."""
    alone, other = (((x[:, 1] - x[:, 0]) / math.sqrt(2)) ** order for x in (a, b))
    cost = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)) ** order
    gain = alone[:, None] + other[None, :] - cost
    total = float(alone.sum() + other.sum())
    if not (gain > 0).any():
        return total ** (1 / order)
    total, free, near = 0.0, np.ones(len(b), bool), gain > 0
    left = np.ones(len(a), bool)
    for i in range(len(a)):
        if not left[i]:
            continue
        rows, columns = np.zeros(len(a), bool), np.zeros(len(b), bool)
        rows[i], grown = True, True
        while grown:
            columns = near[rows].any(0)
            more = near[:, columns].any(1) | rows
            grown, rows = bool((more != rows).any()), more
        left &= ~rows
        free &= ~columns
        r, c = np.flatnonzero(rows), np.flatnonzero(columns)
        if not len(c):
            total += float(alone[i])
        elif len(r) == len(c) == 1:
            total += float(cost[i, c[0]])
        else:
            square = np.zeros((len(r) + len(c),) * 2)
            square[: len(r), : len(c)] = cost[np.ix_(r, c)]
            square[: len(r), len(c) :] = alone[r][:, None]
            square[len(r) :, : len(c)] = other[c][None, :]
            total += assignment(square)[1]
    return (total + float(other[free].sum())) ** (1 / order)


def bottleneck(a, b) -> float:
    """Bottleneck distance (largest coordinate difference): the least radius with a perfect matching."""
    a, b = _finite(a), _finite(b)
    if len(a) + len(b) == 0:
        return 0.0
    return _bottleneck_line(a, b) if _one_birth(a, b) else _bottleneck_plane(a, b)


def _bottleneck_plane(a: np.ndarray, b: np.ndarray) -> float:
    """The least radius within which the bars of either side that reach beyond it find partners. Both sides can be served at once if
    each can alone, as matchings of bipartite graphs combine."""
    alone, other = ((x[:, 1] - x[:, 0]) / 2 for x in (a, b))
    cost = np.abs(a[:, None, :] - b[None, :, :]).max(-1)
    radii = np.unique(np.concatenate([np.zeros(1), alone, other, cost.ravel()]))
    low, high = 0, int(np.searchsorted(radii, max([0.0, *alone.tolist(), *other.tolist()])))  # there all go to the diagonal
    while low < high:
        mid = (low + high) // 2
        within = cost <= radii[mid]
        if _covered(within[alone > radii[mid]]) and _covered(within.T[other > radii[mid]]):
            high = mid
        else:
            low = mid + 1
    return float(radii[low])


def _covered(allowed: np.ndarray) -> bool:
    """Whether every row can have a column of its own, by augmenting paths; rows as bit masks."""
    masks = [int.from_bytes(row.tobytes(), "little") for row in np.packbits(allowed, axis=1, bitorder="little")]
    owner: dict[int, int] = {}
    column_of: dict[int, int] = {}
    for row in range(len(masks)):
        came: dict[int, int] = {}
        queue, seen, end = [row], 0, -1
        while queue and end < 0:
            x = queue.pop()
            new = masks[x] & ~seen
            seen |= new
            while new:
                c = (new & -new).bit_length() - 1
                new &= new - 1
                came[c] = x
                if c not in owner:
                    end = c
                    break
                queue.append(owner[c])
        if end < 0:
            return False
        while True:
            x = came[end]
            before = column_of.get(x, -1)
            owner[end], column_of[x] = x, end
            if x == row:
                break
            end = before
    return True


_erf = np.vectorize(math.erf, otypes=[float])


def persistence_image(diagram, birth_range: tuple[float, float], pers_range: tuple[float, float], resolution: int = 40, sigma: float | None = None) -> np.ndarray:
    """Persistence image: Gaussians at (birth, persistence), weighted by persistence, integrated over the pixels of
    a fixed grid (resolution pixels on either axis). sigma defaults to one pixel."""
    p = _finite(diagram)
    out = np.zeros((resolution, resolution))
    if not len(p):
        return out
    pers = p[:, 1] - p[:, 0]
    bx, py = np.linspace(*birth_range, resolution + 1), np.linspace(*pers_range, resolution + 1)
    s = sigma or max((pers_range[1] - pers_range[0]) / resolution, 1e-12)
    inside = lambda grid, c: np.diff(0.5 * (1 + _erf((grid[None, :] - c[:, None]) / (s * math.sqrt(2)))), axis=1)
    return np.einsum("n,ni,nj->ij", pers, inside(bx, p[:, 0]), inside(py, pers))


def ssa_first_share(x: np.ndarray) -> float:
    """Share of the largest eigenvalue of the lagged covariance with a window of an eighth of the series."""
    width = max(2, len(x) // 8)
    if len(x) - width + 1 < 2:
        return 0.0
    windows = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), width)
    values = np.clip(np.linalg.eigvalsh(windows.T @ windows / len(windows)), 0, None)
    return float(values[-1] / (values.sum() + 1e-12))


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, f = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    total = f
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            f = 1 / (1 + step * f)
            c = 1 + step / c
            total *= c * f
        if abs(c * f - 1) < 1e-14:
            break
    return front * total


def t_pvalue(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def wilcoxon_pvalue(x) -> float:
    """Two-sided signed-rank p-value: exact up to 25 values without ties, else by the normal limit."""
    x = np.asarray(x, float)
    x = x[x != 0]
    n = len(x)
    if n == 0:
        return 1.0
    size = np.abs(x)
    ranks = np.array([(size < v).sum() + ((size == v).sum() + 1) / 2 for v in size])
    w = min(ranks[x > 0].sum(), ranks[x < 0].sum())
    if n <= 25 and len(np.unique(size)) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r].copy()
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2**n))
    _, ties = np.unique(size, return_counts=True)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48)
    return float(math.erfc(abs(w - n * (n + 1) / 4) / sd / math.sqrt(2))) if sd else 1.0
