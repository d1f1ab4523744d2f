"""Overlaps of segments of any length, against all pairs."""

import random

from strandlake.operators import intervals


def test_segments_of_any_length(spark):
    """Segments far longer than a fixed bin; a few that are short, equal, touching, or lack a type."""
    rng = random.Random(7)
    big = 10**15
    rows = [(i, rng.randint(0, 1), rng.choice("ab"), s := rng.randint(0, big), s + rng.randint(1, big)) for i in range(40)]
    rows += [(50 + i, 0, "a", s := 100 * rng.randint(0, 3), s + rng.choice([1, 100, 200])) for i in range(12)] + [(90, 0, None, 0, big), (91, 0, "b", 0, 100)]
    df = spark.createDataFrame(rows, "id long, chr int, type string, start long, stop long")
    got = [(r.l_id, r.r_id, r.overlap, r.l_share) for r in intervals.compare_segments(df, df).collect()]
    want = [(a[0], b[0], n, n / (a[4] - a[3])) for a in rows for b in rows if a[1:3] == b[1:3] and a[2] and (n := min(a[4], b[4]) - max(a[3], b[3])) > 0]
    assert sorted(got) == sorted(want) and len(want) > 300


def test_long_outliers_fill_few_bins(spark, monkeypatch):
    """The join gets two and a half rows for a segment at most."""
    rows = [(i, 0, "a", 10 * i, 10 * i + 5) for i in range(999)] + [(999, 0, "a", 0, 10**9)]
    df = spark.createDataFrame(rows, "id long, chr int, type string, start long, stop long").cache()
    widths = []
    join = intervals.overlap_join
    monkeypatch.setattr(intervals, "overlap_join", lambda a, b, *x, **y: widths.append(y["width"]) or join(a, b, *x, **y))
    assert intervals.compare_segments(df, df).count() == 1000 + 2 * 999
    assert sum((r[4] - 1) // widths[0] - r[3] // widths[0] + 1 for r in rows) <= 2500
    df.unpersist()
