"""Sliding ranks and quantiles against pandas; a row's cost does not follow the window's length."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest

from tidemark.operators.ordered import slide


@pytest.mark.parametrize("n", [1, 2, 5, 60, 500])
def test_sliding_order_against_pandas(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 30, 300).astype(float)
    x[rng.random(300) < 0.1] = np.nan
    x[:4] = np.nan
    ranks, found = slide(x, n, (0.8, 0.2, 0.0, 1.0))
    roll = pd.Series(x).rolling(n, min_periods=1)
    want = roll.rank(pct=True).to_numpy()
    want[np.isnan(x)] = np.nan
    np.testing.assert_allclose(ranks, want)
    for k, share in enumerate((0.8, 0.2, 0.0, 1.0)):
        np.testing.assert_allclose(found[k], roll.quantile(share).to_numpy())


def test_no_rows_and_no_values():
    ranks, found = slide(np.zeros(0), 5, (0.5,))
    assert len(ranks) == 0 and found.shape == (1, 0)
    assert np.isnan(slide(np.full(3, np.nan), 2, (0.5,))[1]).all()


def test_cost_is_flat_in_the_window():
    x = np.random.default_rng(1).normal(size=40_000)

    def took(n):
        began = time.process_time()
        slide(x, n, (0.5,))
        return time.process_time() - began

    took(5)
    assert min(took(1_000) for _ in range(3)) < 4 * min(took(10) for _ in range(3))
