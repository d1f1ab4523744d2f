"""The bound of the depth query."""

from strandlake.operators import intervals
from strandlake.plans import interval_queries, registry

SF = "/root/testdata/sf0.001"


def test_depth_takes_intervals_below_a_megabase(spark, monkeypatch):
    asked = []
    depth = intervals.depth
    monkeypatch.setattr(interval_queries.iv, "depth", lambda df, size, longest, *x: asked.append(longest) or depth(df, size, longest, *x))
    registry.QUERIES["depth_1k"](spark, SF)
    assert asked == [1_000_000]
