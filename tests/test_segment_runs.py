"""Pairs of segments lie in runs of equal values, and are those of all pairs."""

import random
from itertools import pairwise

from pyspark.sql import functions as F

from strandlake.operators import intervals


def test_pairs_lie_in_runs(spark, tmp_path):
    """Segments that share their places, in random order: one run for a segment and bin, and one in it for a place."""
    rng = random.Random(11)
    places = [(c, t, s, s + n) for c in range(2) for t in "ab" for s in range(0, 200, 20) for n in (30, 90)]
    rows = [(i, *places[i % len(places)]) for i in range(12 * len(places))] + [(9999, 0, None, 0, 50), (9998, None, "a", 0, 50)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, chr int, type string, start long, stop long")
    intervals.compare_segments(df, df).write.parquet(str(tmp_path / "pairs"))
    files = {}
    for r in spark.read.parquet(str(tmp_path / "pairs")).withColumn("file", F.input_file_name()).collect():
        files.setdefault(r.file, []).append(r)
    got = [r for f in files.values() for r in f]
    want = [(a[0], b[0], n, n / (a[4] - a[3])) for a in rows for b in rows if a[1:3] == b[1:3] and None not in a and (n := min(a[4], b[4]) - max(a[3], b[3])) > 0]
    assert sorted((r.l_id, r.r_id, r.overlap, r.l_share) for r in got) == sorted(want)
    runs = lambda key: sum(1 + sum(key(x) != key(y) for x, y in pairwise(f)) for f in files.values())
    width = 2 * 60  # twice the mean length
    bins = [(r[0], b) for r in rows if None not in r for b in range(r[3] // width, (r[4] - 1) // width + 1)]
    assert runs(lambda r: r.l_id) <= len(bins)
    assert runs(lambda r: (r.l_id, r.r_start, r.r_stop)) == len({(r.l_id, r.r_start, r.r_stop) for r in got}) <= len(want) / 12
