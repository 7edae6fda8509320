"""NumPy kernels of series: one array of numbers a row, inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries of the matrices that a kernel holds at once.
CELLS = 1 << 20


def each(found: Callable, missing: Callable, kind: str, out: pa.DataType) -> Callable[[Column], Column]:
    """A column function of arrays of numbers: found(values) of each, missing(length) where an element is null, null for a null
    array."""

    def run(x: pa.Array) -> pa.Array:
        flat = x.flatten()
        holes = np.asarray(flat.is_null())
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)))
        known = np.asarray(x.is_valid())
        got = []
        with np.errstate(all="ignore"):
            for k, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                got.append(None if not known[k] else missing(high - low) if holes[low:high].any() else found(values[low:high]))
        return pa.array(got, out)

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def _sum(v) -> float:
    """Added up from the left, as an aggregate over an array does."""
    return v.cumsum()[-1] if len(v) else 0.0


def first_zero(v) -> int:
    """The first lag below a third of the length with an autocorrelation not above 0, else 1."""
    n = len(v)
    if n < 6:
        return 1
    c = v - _sum(v) / n
    z = _sum(c * c)
    if z == 0:
        return 1
    for k in range(1, n // 3):
        if _sum(c[: n - k] * c[k:]) / z <= 0:
            return k
    return 1


def power(v):
    """Squared modulus of the Fourier sums at frequencies 0..n/2 of the centred series."""
    if not len(v):
        return np.zeros(1)
    f = np.fft.rfft(v - _sum(v) / len(v))
    return f.real * f.real + f.imag * f.imag


def entropy(v, m: int, factor: float, min_len: int) -> float:
    """-log of the share of matching templates of m + 1 among those of m; 0 for short, constant or infinite series and where a
    share is 0. Rows of the matrix of differences are taken some at a time."""
    n = len(v)
    if n < max(min_len, m + 2) or not np.isfinite(v).all():
        return 0.0
    c = v - _sum(v) / n
    r = factor * np.sqrt(_sum(c * c) / n)
    if not 0 < r < np.inf:
        return 0.0
    hits, step = [0, 0], max(1, CELLS // n)
    for low in range(0, n, step):
        near = np.abs(v[low : low + step + m, None] - v[None, :]) <= r
        for k, size in enumerate((m, m + 1)):
            count = n - size + 1
            rows = min(low + step, count) - low
            if rows > 0:
                both = near[:rows, :count]
                for s in range(1, size):
                    both = both & near[s : s + rows, s : s + count]
                hits[k] += int(np.count_nonzero(both)) - rows  # less the matches with themselves
    a, b = (h / ((n - s + 1) * (n - s)) for h, s in zip(hits[::-1], (m + 1, m), strict=True))
    return float(-np.log(a / b)) + 0.0 if a > 0 and b > 0 else 0.0


def _bins(v, bins: int):
    """Numbers of equal-width bins, the last one closed; equal values make one bin."""
    lo, hi = v.min(), v.max()
    if not hi > lo:
        return np.zeros(len(v), np.int64)
    at = (v - lo) / (hi - lo) * bins
    return np.minimum(np.floor(np.where(np.isnan(at), 0.0, at)), bins - 1).astype(np.int64)


def _information(a, b, bins: int):
    """Mutual information in bits of the columns of bins a and b, row by row."""
    rows, n = a.shape
    cells = np.bincount((np.arange(rows)[:, None] * bins * bins + a * bins + b).ravel(), minlength=rows * bins * bins).reshape(rows, bins, bins) / n
    expected = cells.sum(2)[:, :, None] * cells.sum(1)[:, None, :] + 1e-12
    return np.where(cells > 0, cells * np.log2(np.where(cells > 0, cells, 1.0) / expected), 0.0).sum((1, 2))


def first_below(v, most: int, bins: int) -> int:
    """The first delay whose circularly shifted mutual information lies below that of neighbouring samples, else 1. A shift
    keeps the values and so their bins. v: finite, at least two."""
    n = len(v)
    near = _information(_bins(v[:-1], bins)[None], _bins(v[1:], bins)[None], bins)[0]
    b, top = _bins(v, bins), min(most, n // 3) - 1
    step = max(1, CELLS // max(n, bins * bins))
    for low in range(1, top + 1, step):
        taus = np.arange(low, min(low + step, top + 1))
        moved = b[(np.arange(n)[None, :] + taus[:, None]) % n]
        below = np.flatnonzero(_information(np.broadcast_to(b, moved.shape), moved, bins) < near)
        if len(below):
            return int(taus[below[0]])
    return 1
