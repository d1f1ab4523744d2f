"""Queries of the interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.coords import in_region
from ..operators import intervals as iv
from ..shared import stored
from . import model as m
from .model import rounded
from .registry import query


@query("region_filter", f"WITH {m.MUMS} SELECT pair_id, ord, chr, pos FROM mums WHERE chr = 1 AND pos >= 300 AND pos < 900")
def _(t):
    """A one-based, inclusive region."""
    return t.mums.filter(in_region("1:301-900")).select("pair_id", "ord", "chr", "pos")


@query("point_to_gene", f"WITH {m.POINTS}, {m.GENES} SELECT p.chr, p.pos, g.name FROM points p JOIN genes g ON p.chr = g.chr AND g.start < p.pos AND p.pos < g.stop")
def _(t):
    """Genes strictly around a point."""
    return iv.genes_at_points(t.points, t.genes).select("chr", "pos", F.col("r_name").alias("name"))


@query("interval_to_gene_exons", f"""WITH {m.GAPS}, {m.GENES} SELECT l.start, l.stop, l.type, g.name, CAST(len(list_filter(g.exons, lambda e: e.a < l.stop AND l.start < e.b)) AS INTEGER) AS exon_hits
FROM gaps l JOIN genes g ON l.chr = g.chr AND l.start < g.stop AND g.start < l.stop""")
def _(t):
    """Genes under an interval, with exon hits."""
    g = iv.genes_in_intervals(t.gaps, t.genes)
    return g.select(F.col("l_start").alias("start"), F.col("l_stop").alias("stop"), F.col("l_type").alias("type"), F.col("r_name").alias("name"), "exon_hits")


@query("gene_stretches", f"""WITH {m.GENES}, e AS (SELECT chr, pos, sum(d) AS d FROM (SELECT chr, start AS pos, 1 AS d FROM genes UNION ALL SELECT chr, stop, -1 FROM genes) GROUP BY ALL)
SELECT chr, start, stop, CAST(n_genes AS BIGINT) AS n_genes FROM (SELECT chr, pos AS start, lead(pos) OVER w AS stop, sum(d) OVER (PARTITION BY chr ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n_genes FROM e WINDOW w AS (PARTITION BY chr ORDER BY pos)) WHERE stop IS NOT NULL AND n_genes > 0""")
def _(t):
    """Disjoint stretches with the number of active genes."""
    return iv.flatten_genes(t.genes)


@query("nearest_gap", f"""WITH {m.POINTS}, {m.GAPS}, d AS (SELECT p.chr, p.pos, CASE WHEN g.start <= p.pos AND p.pos < g.stop THEN 0 WHEN p.pos < g.start THEN g.start - p.pos ELSE p.pos - g.stop + 1 END AS distance FROM points p JOIN gaps g ON p.chr = g.chr)
SELECT chr, pos, CAST(min(distance) AS BIGINT) AS distance FROM d GROUP BY 1, 2""")
def _(t):
    """Distance to the nearest gap."""
    return iv.nearest_gap(t.points, t.gaps).select("chr", "pos", "distance")


@query("best_repeat", f"WITH {m.POINTS}, {m.REPEATS} SELECT p.chr, p.pos, max(r.stop - r.start) AS total_length FROM points p JOIN repeats r ON p.chr = r.chr AND r.start <= p.pos AND p.pos < r.stop GROUP BY 1, 2")
def _(t):
    """Longest covering repeat."""
    return iv.best_repeat(t.points, t.repeats).select("chr", "pos", "total_length")


_SEG_SQL = f"""WITH {m.INTERVALS}, s AS (SELECT chr, start, stop, type, user_id FROM intervals)
SELECT a.user_id AS a_user, b.user_id AS b_user, a.start AS a_start, b.start AS b_start, least(a.stop, b.stop) - greatest(a.start, b.start) AS overlap, (least(a.stop, b.stop) - greatest(a.start, b.start)) / CAST(a.stop - a.start AS DOUBLE) AS share
FROM s a JOIN s b ON a.chr = b.chr AND a.type = b.type AND a.user_id < b.user_id AND a.start < b.stop AND b.start < a.stop"""


@query("segment_overlap", _SEG_SQL)
def _(t):
    """Overlaps of segments of the same type."""
    s = stored(t.intervals, "segments")
    c = iv.compare_segments(s, s).filter("l_user_id < r_user_id")
    return c.select(F.col("l_user_id").alias("a_user"), F.col("r_user_id").alias("b_user"), F.col("l_start").alias("a_start"), F.col("r_start").alias("b_start"), "overlap", F.col("l_share").alias("share"))


@query("merged_intervals", f"""WITH {m.GENES}, r AS (SELECT *, max(stop) OVER (PARTITION BY chr ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM genes),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT chr, min(start) AS start, max(stop) AS stop, count(*) AS n FROM i GROUP BY chr, island""")
def _(t):
    """Intervals closer than 5 merge."""
    return iv.merge_intervals(t.genes, 5).select("chr", "start", "stop", "n")


@query("gene_coverage", f"WITH {m.GENES} SELECT chr, count(DISTINCT p) AS bases FROM (SELECT chr, unnest(range(start, stop)) AS p FROM genes) GROUP BY 1")
def _(t):
    """Bases under any gene."""
    return iv.covered_bases(t.genes)


@query("width_of_runs", f"""WITH {m.PROFILE}, r AS (SELECT *, CASE WHEN lag(seg_ratio) OVER w = seg_ratio THEN 0 ELSE 1 END AS c FROM profile WINDOW w AS (PARTITION BY sample, chr ORDER BY bin)),
s AS (SELECT *, sum(c) OVER (PARTITION BY sample, chr ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run FROM r) SELECT sample, chr, seg_ratio, min(bin) AS first, max(bin) AS last, count(*) AS n FROM s GROUP BY sample, chr, run, seg_ratio""")
def _(t):
    """Runs of equal segment ratio."""
    return iv.run_lengths(t.profile, ["sample", "chr"], "bin", "seg_ratio").select("sample", "chr", "seg_ratio", "first", "last", "n")


@query("peaks_over_threshold", """WITH e AS (SELECT *, CASE WHEN value > 50 THEN 1 WHEN value < 50 THEN 0 END AS s FROM events),
h AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS st FROM e),
c AS (SELECT *, CASE WHEN lag(st) OVER (PARTITION BY event_type ORDER BY ts) = st THEN 0 ELSE 1 END AS ch FROM h),
r AS (SELECT *, sum(ch) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM c),
g AS (SELECT event_type, run, st, min(ts) AS start, max(value) AS height FROM r GROUP BY ALL), l AS (SELECT *, lead(start) OVER (PARTITION BY event_type ORDER BY run) AS stop FROM g)
SELECT event_type, start, stop, height FROM l WHERE st = 1 AND stop IS NOT NULL""")
def _(t):
    """Stretches above a level that come down again."""
    return iv.peaks(t.events, ["event_type"], "ts", "value", 50.0)


@query("depth_1k", f"""WITH {m.INTERVALS}, s AS (SELECT * FROM intervals WHERE stop - start < 1000000), b AS (SELECT chr, start, stop, unnest(range(start // 1000, (stop - 1) // 1000 + 1)) AS bin FROM s)
SELECT chr, CAST(bin AS BIGINT) AS bin, round(sum(least(stop, (bin + 1) * 1000) - greatest(start, bin * 1000)) / 1000.0 / 2, 6) AS depth FROM b GROUP BY 1, 2""")
def _(t):
    """Mean depth per kilobase."""
    return iv.depth(t.intervals, 1000, 1_000_000, 2.0).withColumn("depth", rounded("depth"))


@query("event_histogram", f"WITH {m.INTERVALS} SELECT chr, CAST(start // 5000 AS BIGINT) AS bin, count(*) AS n, count(DISTINCT type) AS tags FROM intervals GROUP BY 1, 2")
def _(t):
    """Events and tags per bin."""
    return iv.event_histogram(t.intervals.withColumnRenamed("start", "pos"), 5000, "type")


_MAPPA = "mappa AS (SELECT CAST(c AS INTEGER) AS chr, CAST(p AS BIGINT) AS pos, CAST(10 + (p * 7 + c) % 23 AS INTEGER) AS low, CAST(12 + (p * 5 + c) % 19 AS INTEGER) AS high FROM range(3) a(c), range(1400) b(p))"


def mappa(t):
    """A made-up mappability of three chromosomes."""
    return t.spark.range(3 * 1400).select((F.col("id") % 3).cast("int").alias("chr"), F.floor(F.col("id") / 3).alias("pos")).select(
        "chr", "pos", (10 + (F.col("pos") * 7 + F.col("chr")) % 23).cast("int").alias("low"), (12 + (F.col("pos") * 5 + F.col("chr")) % 19).cast("int").alias("high")
    )


@query("region_mappability", f"""WITH {m.MUMS}, {_MAPPA}, r AS (SELECT DISTINCT chr, pos, len FROM mums), s AS (SELECT chr, pos, len, unnest(range(pos, pos + len)) AS p FROM r),
j AS (SELECT s.*, low FROM s JOIN mappa m ON s.chr = m.chr AND s.p = m.pos), u AS (SELECT *, min(low) OVER (PARTITION BY chr, pos, len ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM j),
x AS (SELECT *, coalesce(max(CASE WHEN p + run > pos + len THEN 1 ELSE 0 END) OVER (PARTITION BY chr, pos, len ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM u)
SELECT chr, pos, len, arg_max(run, p) AS mappability FROM x WHERE stopped = 0 GROUP BY 1, 2, 3""")
def _(t):
    """Running minimum of mappability with its early stop."""
    return iv.range_mappability(t.placed.select("chr", "pos", "len").distinct(), mappa(t))


@query("base_track", f"""WITH {m.GENES}, c AS (SELECT chr, p FROM (SELECT DISTINCT chr FROM genes WHERE start < 400 AND stop > 200), range(200, 400) t(p))
SELECT chr, string_agg(CASE WHEN EXISTS (SELECT 1 FROM genes g WHERE g.chr = c.chr AND g.start <= p AND p < g.stop) THEN '*' ELSE '-' END, '' ORDER BY p) AS track FROM c GROUP BY 1""")
def _(t):
    """A track of marks."""
    return iv.paint_track(t.genes, 200, 400)


_TRUTH_SQL = f"""WITH {m.INTERVALS}, k AS (SELECT *, row_number() OVER (ORDER BY user_id, start) AS id FROM intervals), a AS (SELECT * FROM k WHERE user_id % 2 = 0), b AS (SELECT * FROM k WHERE user_id % 2 = 1),
h AS (SELECT a.id AS x, b.id AS y FROM a JOIN b ON a.chr = b.chr AND a.type = b.type AND a.start < b.stop AND b.start < a.stop)
SELECT (SELECT count(DISTINCT x) FROM h) AS found, (SELECT count(*) FROM a) - (SELECT count(DISTINCT x) FROM h) AS missed, (SELECT count(*) FROM b) - (SELECT count(DISTINCT y) FROM h) AS "false" """


@query("truth_comparison", _TRUTH_SQL)
def _(t):
    """Known against called events."""
    s = t.intervals
    return iv.found_missed_false(s.filter("user_id % 2 = 0"), s.filter("user_id % 2 = 1"))
