"""Circular binary segmentation at full resolution, also on long profiles."""

import numpy as np
import pytest

from strandlake.operators import models


@pytest.mark.parametrize("n", [257, 300, 700, 1000])
def test_pruned_search_finds_the_best_arc(n):
    for seed in range(6):
        y = np.random.default_rng(seed).normal(size=n)
        y[n // 3 : n // 3 + seed * 5] += 1.5
        assert models._best_arc(y) == models._best_arc(y, block=n)  # such a block is searched in full


def test_cuts_of_long_profiles_lie_on_points():
    y = np.random.default_rng(5).normal(0, 0.2, 6001)
    y[1003:2006] += 1
    y[4001:4004] += 3  # shorter than the means once taken, and off their grid
    y[5990:] -= 2
    assert models.cbs_cuts(y) == [1003, 2006, 4001, 4004, 5990]
