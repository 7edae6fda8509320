"""Sums of gradients by row of the weight matrix, against adding one line after the other."""

import numpy as np
import pytest

from simplicia.llm import maxent


@pytest.mark.parametrize("most", [1, 2, maxent.TOGETHER, maxent.TOGETHER + 1, 3000])
@pytest.mark.parametrize("width", [1, 16, 37])
def test_sums_by_row(most, width):
    rng = np.random.default_rng(most + width)
    rows = rng.permutation(np.concatenate([np.full(most, 65535), np.repeat(np.arange(40), rng.integers(1, most + 1, 40)), [70, 70, 71]])).astype(np.uint16)
    g = rng.standard_normal((len(rows), width)).astype(np.float32)
    at, total, n = maxent.sums_by_row(g, rows)
    want, seen = np.zeros((65536, width)), np.bincount(rows, minlength=65536)
    np.add.at(want, rows, g.astype(float))
    assert sorted(at.tolist()) == np.unique(rows).tolist() and np.array_equal(n, seen[at])
    assert np.allclose(total, want[at], rtol=1e-4, atol=1e-3)


def test_update_moves_each_row_by_its_scaled_sum():
    """The step of a row as written in Trainer, one feature after the other."""
    rng = np.random.default_rng(2)
    w = rng.standard_normal((50, 8)).astype(np.float32)
    rows, target = rng.integers(0, 50, (2, 400)).astype(np.uint16), rng.integers(0, 8, 400)
    bias = np.zeros(8, np.float32)
    trainer = maxent.Trainer(w)
    trainer.update(rows, target, bias)
    z = w[rows[0]].astype(float) + w[rows[1]]
    g = np.eye(8)[target] - np.exp(z) / np.exp(z).sum(1, keepdims=True)
    want, squares = w.astype(float), np.full(50, 1e-2)
    for r in rows:
        total = np.zeros((50, 8))
        np.add.at(total, r, g)
        squares += (total**2).mean(1)
        want += total * (maxent.RATE / np.sqrt(squares))[:, None]
    assert np.allclose(trainer.w, want, atol=1e-4) and np.array_equal(trainer.start, w)
    assert np.array_equal(trainer.used, np.bincount(rows.ravel(), minlength=50))
