"""Rows with an overlap, found without pairs, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import intervals

SCHEMA = "id long, chr int, type string, start long, stop long"


def some(seed, n):
    rng = random.Random(seed)
    rows = [(i, rng.randint(0, 2), rng.choice("ab"), s := rng.randint(-90, 300), s + rng.choice([0, 1, 2, 3, 9, 40, -2])) for i in range(n)]
    return rows + [(900, None, "a", 0, 50), (901, 1, None, 0, 50), (902, 1, "a", None, 50), (903, 1, "a", 0, None)]


def meets(a, b):
    return None not in a and None not in b and a[1:3] == b[1:3] and a[3] < b[4] and b[3] < a[4]


@pytest.mark.parametrize("size", [7, 100_000])
def test_overlapped_rows(spark, size):
    a, b = some(1, 120), some(2, 60)
    got = intervals.overlapped(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), rows_per_bin=size).collect()
    assert sorted(tuple(r) for r in got) == [x for x in a if any(meets(x, y) for y in b)]
    assert 20 < len(got) < 110


def test_truth_comparison_makes_no_pairs(spark, monkeypatch):
    """40,000 events over as many calls have 1.6 thousand million pairs; one event and two calls meet none."""
    monkeypatch.setattr(intervals, "overlap_join", None)
    near = spark.range(40_000).select("id", F.lit(1).alias("chr"), F.lit("a").alias("type"), F.lit(0).cast("long").alias("start"), (F.col("id") + 1).alias("stop"))
    far = spark.createDataFrame([(50_000, 1, "b", 0, 50)], SCHEMA)
    odd = spark.createDataFrame([(50_000, 1, "a", -50, 0), (50_001, 1, None, 0, 50)], SCHEMA)
    assert tuple(intervals.found_missed_false(near.union(far), near.union(odd)).first()) == (40_000, 1, 2)
