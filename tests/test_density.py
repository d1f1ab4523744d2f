"""Densities of odd rows and of many equal or near points, against all pairs."""

import random

import numpy as np
import pytest
from strandlake.operators import models
from strandlake.plans import registry


@pytest.mark.parametrize("places", [7, 250_000])
def test_density_counts_different_rows(spark, places, monkeypatch):
    """Rows that repeat, places that repeat, missing and infinite places, and cells in many parts."""
    monkeypatch.setattr(models, "DENSITY_PLACES", places)
    rng = random.Random(3)
    rows = [(i % 150, float(rng.randint(-6, 6)), rng.randint(-60, 60) / 10) for i in range(200)]
    rows += rows[:20] + [(500, None, 1.0), (501, 1.0, float("nan")), (502, float("inf"), 0.0), (503, 3.0, -1e-17), (504, -1e-17, -1e-17), (505, 1e300, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = [tuple(r) for r in models.grid_density(df, "x", "y", 3.0, 3.0).collect()]
    sound = {r for r in rows if None not in r and abs(r[1]) < float("inf") and r[2] == r[2]}
    want = [(*a, sum((a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]) <= 9 for b in sound)) for a in sound]
    assert sorted(got) == sorted(want)


def test_near_counts_decide_boxes_at_once(monkeypatch):
    monkeypatch.setattr(models, "DENSITY_LEAF", 4)
    rng = np.random.default_rng(1)
    p, q = rng.integers(0, 80, (300, 2)) / 10, rng.integers(0, 80, (400, 2)) / 10
    n = rng.integers(1, 5, 400)
    d = p[:, None] - q[None]
    want = ((d * d).sum(2) <= 9) @ n
    assert (models.near_counts(*p.T, *q.T, n, 3.0) == want).all()


def test_density_query_takes_an_id_once(spark, tmp_path):
    """As its SQL: different points only, summed by id."""
    part = [(1, 5, 900.0), (1, 5, 900.0), (1, 6, 900.0), (2, 5, 910.0), (3, None, 900.0)]
    spark.createDataFrame(part, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["grid_density"](spark, str(tmp_path)).collect())
    assert got == [(1, 6), (2, 3)]
