"""Operators on half-open intervals and on ordered series."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored

#: Bins of a chromosome, at most.
MAX_BINS = 1024


def _bins(start: Column, stop: Column, width: int) -> Column:
    """All bin numbers that [start, stop) touches."""
    return F.sequence(F.floor(start / width), F.floor((F.greatest(stop, start + 1) - 1) / width))


def overlap_join(left: DataFrame, right: DataFrame, chr_col: str = "chr", width: int = 10_000, how: str = "inner", same: tuple[str, ...] = (), runs: bool = False) -> DataFrame:
    """Pairs of overlapping intervals (``l_start < r_stop and r_start < l_stop``).

    Both sides have ``start`` and ``stop``, prefixed l_ and r_ in the result. The
    condition alone would compare everything with everything; instead intervals
    are put into bins and joined on (chromosome, bin), a plain equi-join, and a
    pair is taken only in the first bin that it shares, so it comes once. A pair
    is found for any lengths; long intervals just fill more bins. Pairs also agree
    in the columns ``same``.

    With ``runs``, a merge join of sorted sides, the pairs of one left interval
    follow one another by the right start and stop, and left intervals by length.
    Columns then have long runs of equal values, so a large result has small files.
    """
    ls = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    rs = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    ls = ls.withColumn("__b", F.explode(_bins(F.col("l_start"), F.col("l_stop"), width)))
    rs = rs.withColumn("__c", F.explode(_bins(F.col("r_start"), F.col("r_stop"), width)))
    if runs:  # the optimizer drops a plain sort below a join, but not that of a window, and a merge join keeps it
        row = lambda side, bin_, *order: F.row_number().over(Window.partitionBy(*[f"{side}_{c}" for c in (chr_col, *same)], bin_).orderBy(*order))
        ls = ls.withColumn("__i", row("l", "__b", F.col("l_stop") - F.col("l_start"), "l_start")).filter("__i > 0").drop("__i").hint("merge")
        rs = rs.withColumn("__i", row("r", "__c", "r_start", "r_stop")).filter("__i > 0").drop("__i")
    first = F.floor(F.greatest("l_start", "r_start") / width)
    agree = reduce(and_, [F.col(f"l_{c}") == F.col(f"r_{c}") for c in (chr_col, *same)])
    cond = agree & (F.col("__b") == F.col("__c")) & (F.col("l_start") < F.col("r_stop")) & (F.col("r_start") < F.col("l_stop")) & (F.col("__b") == first)
    return ls.join(rs, cond, how).drop("__b", "__c")


def point_join(points: DataFrame, intervals: DataFrame, pos: str = "pos", chr_col: str = "chr", width: int = 10_000, strict: bool = False) -> DataFrame:
    """Pairs of points and the intervals that cover them: start <= pos < stop, or start < pos < stop if ``strict``.

    A point is in one bin, so only intervals are repeated.
    """
    rs = intervals.select(*[F.col(c).alias(f"r_{c}") for c in intervals.columns])
    rs = rs.withColumn("__c", F.explode(_bins(F.col("r_start"), F.col("r_stop"), width)))
    low = F.col("r_start") < F.col(pos) if strict else F.col("r_start") <= F.col(pos)
    cond = (F.col(chr_col) == F.col(f"r_{chr_col}")) & (F.floor(F.col(pos) / width) == F.col("__c")) & low & (F.col(pos) < F.col("r_stop"))
    return points.join(rs, cond).drop("__c")


def genes_at_points(points: DataFrame, genes: DataFrame, pos: str = "pos") -> DataFrame:
    """Genes strictly around a point, of any length."""
    return point_join(points, genes, pos, strict=True)


def genes_in_intervals(intervals: DataFrame, genes: DataFrame) -> DataFrame:
    """Overlapped genes with the number of overlapped exons (``exons``: array of start, stop)."""
    hits = F.size(F.filter("r_exons", lambda e: (e["start"] < F.col("l_stop")) & (F.col("l_start") < e["stop"])))
    return overlap_join(intervals, genes).withColumn("exon_hits", hits)


def flatten_genes(genes: DataFrame) -> DataFrame:
    """Disjoint stretches with the number of genes over each, from interval ends as events."""
    events = genes.select("chr", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("pos"), F.lit(-1).alias("d")))).alias("e")).select("chr", "e.pos", "e.d")
    steps = events.groupBy("chr", "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("chr").orderBy("pos")
    depth = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return steps.select("chr", F.col("pos").alias("start"), F.lead("pos").over(w).alias("stop"), depth.alias("n_genes")).filter("stop IS NOT NULL AND n_genes > 0")


def nearest_gap(points: DataFrame, gaps: DataFrame, default: int = 10**9, rows_per_bin: int = 100_000) -> DataFrame:
    """Distance to the nearest interval of the chromosome (0 inside) and its type; (default, none) without one.

    Gaps need not be disjoint. Points and gap ends are put in one order; inside a
    (chromosome, bin) running windows find the nearest end on either side, and one
    row per bin carries the nearest end of the bins before and after. Bins are cut
    at quantiles of the points, so dense places have as many rows as others. No
    pair is made, and no chromosome is one task.
    """
    points = stored(points, "gap-points")
    n = points.count()
    bins_ = min(MAX_BINS, n // rows_per_bin)
    cuts = sorted(set(points.agg(F.percentile_approx("pos", [i / (bins_ + 1) for i in range(1, bins_ + 1)], 10_000)).first()[0] or [])) if bins_ else []
    bounds = F.array(*[F.lit(int(c)) for c in cuts]).cast("array<bigint>")
    end = "struct<at:bigint,type:string>"
    none = F.lit(None).cast(end)
    left = gaps.select("chr", F.col("stop").alias("pos"), F.struct(F.col("stop").alias("at"), "type").cast(end).alias("left"), none.alias("right"), F.lit(0).alias("kind"))
    right = gaps.select("chr", F.col("start").alias("pos"), none.alias("left"), F.struct(F.col("start").alias("at"), "type").cast(end).alias("right"), F.lit(2).alias("kind"))
    mine = points.select("chr", "pos", none.alias("left"), none.alias("right"), F.lit(1).alias("kind"), F.struct(*points.columns).alias("row"))
    empty = F.lit(None).cast(mine.schema["row"].dataType)
    both = left.withColumn("row", empty).unionByName(right.withColumn("row", empty)).unionByName(mine).withColumn("bin", F.size(F.filter(bounds, lambda c: c <= F.col("pos"))))
    here = Window.partitionBy("chr", "bin")
    back = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    sides = both.withColumn("__l", F.last("left", ignorenulls=True).over(back(here.orderBy("pos", "kind")))).withColumn("__r", F.last("right", ignorenulls=True).over(back(here.orderBy(F.desc("pos"), F.desc("kind"))))).filter("kind = 1")
    bins = both.groupBy("chr", "bin").agg(F.max("left").alias("l"), F.min("right").alias("r"))
    strict = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    line = Window.partitionBy("chr")
    carried = bins.select("chr", "bin", F.last("l", ignorenulls=True).over(strict(line.orderBy("bin"))).alias("__cl"), F.last("r", ignorenulls=True).over(strict(line.orderBy(F.desc("bin")))).alias("__cr"))
    out = sides.join(carried, ["chr", "bin"]).select("row.*", F.coalesce("__l", "__cl").alias("__l"), F.coalesce("__r", "__cr").alias("__r"))
    inside = point_join(points, gaps).groupBy(*points.columns).agg(F.min("r_type").alias("__in"))
    out = out.join(inside, points.columns, "left")
    to_left, to_right = F.col("pos") - F.col("__l.at") + 1, F.col("__r.at") - F.col("pos")
    return out.select(
        *points.columns,
        F.when(F.col("__in").isNotNull(), 0).otherwise(F.coalesce(F.least(to_left, to_right), F.lit(default))).cast("long").alias("distance"),
        F.when(F.col("__in").isNotNull(), F.col("__in")).when(F.col("__r").isNull() | (to_left <= to_right), F.coalesce("__l.type", F.lit("none"))).otherwise(F.col("__r.type")).alias("type"),
    )


def best_repeat(points: DataFrame, repeats: DataFrame) -> DataFrame:
    """The longest covering repeat of each point (ties: the smaller motif); points without one are left out."""
    hit = point_join(points, repeats)
    return hit.groupBy(*points.columns).agg(F.max(F.col("r_stop") - F.col("r_start")).alias("total_length"), F.max_by("r_motif", F.col("r_stop") - F.col("r_start")).alias("motif"))


def merge_intervals(df: DataFrame, window: int = 0) -> DataFrame:
    """Union of intervals; those closer than ``window`` become one."""
    w = Window.partitionBy("chr").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach + window), 1).otherwise(0)
    marked = df.select("chr", "start", "stop", new.alias("new"))
    return marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("chr", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n")).drop("island")


def covered_bases(df: DataFrame) -> DataFrame:
    """Bases under any interval, per chromosome."""
    return merge_intervals(df).groupBy("chr").agg(F.sum(F.col("stop") - F.col("start")).alias("bases"))


def run_lengths(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal consecutive values: first and last position, length."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.withColumn("__c", change).withColumn("run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def peaks(df: DataFrame, keys: list[str], order: str, value: str, level: float) -> DataFrame:
    """Stretches above ``level`` that are followed by a value below it, with their maximum; an open last stretch is not told."""
    w = Window.partitionBy(*keys).orderBy(order)
    state = F.when(F.col(value) > level, 1).when(F.col(value) < level, 0)
    held = F.coalesce(F.last(state, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    runs = df.withColumn("__s", held)
    change = F.when(F.lag("__s").over(w) == F.col("__s"), 0).otherwise(1)
    runs = runs.withColumn("__c", change).withColumn("__r", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = runs.groupBy(*keys, "__r", "__s").agg(F.min(order).alias("start"), F.max(order).alias("last"), F.max(value).alias("height"))
    closed = F.lead("start").over(Window.partitionBy(*keys).orderBy("__r"))
    return ends.withColumn("stop", closed).filter("__s = 1 AND stop IS NOT NULL").select(*keys, "start", "stop", "height")


def depth(df: DataFrame, bin_size: int, longest: int, divisor: float = 1.0, keys: list[str] = ()) -> DataFrame:
    """Mean number of intervals over each bin; intervals of ``longest`` or more are left out, empty bins too."""
    short = df.filter((F.col("stop") > F.col("start")) & (F.col("stop") - F.col("start") < longest))
    spread = short.withColumn("bin", F.explode(_bins(F.col("start"), F.col("stop"), bin_size)))
    bases = F.least(F.col("stop"), (F.col("bin") + 1) * bin_size) - F.greatest(F.col("start"), F.col("bin") * bin_size)
    return spread.groupBy(*keys, "chr", "bin").agg((F.sum(bases) / F.lit(bin_size) / F.lit(divisor)).alias("depth"))


def event_histogram(df: DataFrame, bin_size: int, tag: str) -> DataFrame:
    """Events per bin, with the number of different tags."""
    return df.groupBy("chr", F.floor(F.col("pos") / bin_size).alias("bin")).agg(F.count("*").alias("n"), F.count_distinct(tag).alias("tags"))


def range_mappability(ranges: DataFrame, mappability: DataFrame, measure: str = "low", least: bool = True) -> DataFrame:
    """Running extreme of a mappability over [pos, pos + len), up to where the unique stretch would leave the range."""
    spread = ranges.withColumn("p", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1)))
    m = mappability.select(F.col("chr").alias("m_chr"), F.col("pos").alias("m_pos"), F.col(measure).alias("m"))
    met = spread.join(m, (F.col("chr") == F.col("m_chr")) & (F.col("p") == F.col("m_pos")))
    w = Window.partitionBy(*ranges.columns).orderBy("p")
    extreme = (F.min if least else F.max)("m").over(w.rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumn("run", extreme).withColumn("stop_here", (F.col("p") + F.col("run") > F.col("pos") + F.col("len")).cast("int"))
    stopped = F.coalesce(F.max("stop_here").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = met.withColumn("stopped", stopped).filter("stopped = 0")
    return kept.groupBy(*ranges.columns).agg(F.max_by("run", "p").alias("mappability"))


def paint_track(intervals: DataFrame, start: int, stop: int, mark: str = "*", blank: str = "-") -> DataFrame:
    """One character per base of a window, per chromosome."""
    inside = intervals.filter((F.col("start") < stop) & (F.col("stop") > start))
    marks = inside.select("chr", F.explode(F.sequence(F.greatest("start", F.lit(start)), F.least("stop", F.lit(stop)) - 1)).alias("p")).groupBy("chr").agg(F.collect_set("p").alias("on"))
    cells = F.transform(F.sequence(F.lit(start), F.lit(stop - 1)), lambda p: F.when(F.array_contains("on", p.cast("long")), mark).otherwise(blank))
    return marks.select("chr", F.array_join(cells, "").alias("track"))


def compare_segments(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlaps of segments of the same type, in bases and as shares of both.

    Bins are twice as wide as segments are long on average, so the join gets two
    and a half rows for a segment at most, of whatever length. All overlaps are
    returned; their number grows with the square of the segments in one place.
    They lie in runs of equal values, for small files.
    """
    long = a.select("start", "stop").union(b.select("start", "stop")).agg(F.avg(F.greatest(F.col("stop") - F.col("start"), F.lit(1)))).first()[0]
    met = overlap_join(a, b, width=math.ceil(2 * (long or 1)), same=("type",), runs=True)
    shared = F.least("l_stop", "r_stop") - F.greatest("l_start", "r_start")
    return met.withColumn("overlap", shared).withColumn("l_share", F.col("overlap") / (F.col("l_stop") - F.col("l_start"))).withColumn("r_share", F.col("overlap") / (F.col("r_stop") - F.col("r_start")))


def overlapped(df: DataFrame, others: DataFrame, keys: tuple[str, ...] = ("chr", "type"), rows_per_bin: int = 100_000) -> DataFrame:
    """Rows of ``df`` that some interval of ``others`` with the same keys overlaps (``start < other's stop and other's start < stop``).

    There is one if the furthest stop of the others that start before the row's
    stop lies behind its start: a running maximum in one order of row stops and
    other starts, without pairs. It runs inside (keys, bin), with bins cut at
    quantiles of the rows; one row per bin carries the maximum of the bins before.
    """
    known = lambda d: d.na.drop(subset=[*keys, "start", "stop"])
    bins_ = min(MAX_BINS, df.count() // rows_per_bin)
    cuts = sorted(set(df.agg(F.percentile_approx("stop", [i / (bins_ + 1) for i in range(1, bins_ + 1)], 10_000)).first()[0] or [])) if bins_ else []
    bounds = F.array(*[F.lit(int(c)) for c in cuts]).cast("array<bigint>")
    asks = known(df).select(*keys, F.col("stop").alias("__pos"), F.lit(0).alias("__kind"), F.lit(None).cast(others.schema["stop"].dataType).alias("__reach"), F.struct(*df.columns).alias("__row"))
    gives = known(others).select(*keys, F.col("start").alias("__pos"), F.lit(1).alias("__kind"), F.col("stop").alias("__reach"), F.lit(None).cast(asks.schema["__row"].dataType).alias("__row"))
    both = asks.unionByName(gives).withColumn("__bin", F.size(F.filter(bounds, lambda c: c <= F.col("__pos"))))
    here = Window.partitionBy(*keys, "__bin").orderBy("__pos", "__kind").rowsBetween(Window.unboundedPreceding, 0)  # equal places: the row first
    line = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    rows = both.withColumn("__here", F.max("__reach").over(here)).filter("__kind = 0")
    carried = both.groupBy(*keys, "__bin").agg(F.max("__reach").alias("__most")).withColumn("__before", F.max("__most").over(line)).drop("__most")
    return rows.join(carried, [*keys, "__bin"]).filter(F.greatest("__here", "__before") > F.col("__row.start")).select("__row.*")


def found_missed_false(truth: DataFrame, called: DataFrame) -> DataFrame:
    """Known events that some call overlaps, known ones without, and calls without a known event; every row is an event."""
    truth, called = (stored(d.select("chr", "type", "start", "stop"), name) for d, name in ((truth, "truth"), (called, "called")))
    found = overlapped(truth, called).agg(F.count("*").alias("found"))
    matched = overlapped(called, truth).agg(F.count("*").alias("matched"))
    return found.crossJoin(matched).crossJoin(truth.agg(F.count("*").alias("n_truth"))).crossJoin(called.agg(F.count("*").alias("n_called"))).select(  # four single rows
        "found", (F.col("n_truth") - F.col("found")).alias("missed"), (F.col("n_called") - F.col("matched")).alias("false")
    )
