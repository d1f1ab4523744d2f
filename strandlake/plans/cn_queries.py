"""Queries of the copy-number operators and of the models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cn, models, simulate
from . import model as m
from .model import rounded
from .registry import query


@query("fine_counts", f"WITH {m.MUMS} SELECT chr, pos, count(*) AS count FROM mums GROUP BY 1, 2")
def _(t):
    """A10: counts per base, by parts that add up."""
    a, b = t.placed.filter("NOT read_2"), t.placed.filter("read_2")
    return cn.add_fine_counts([cn.fine_counts(a), cn.fine_counts(b)])


_BINS = "bins AS (SELECT CAST(k AS INTEGER) AS bin, CAST(k // 20 AS INTEGER) AS chr, CAST(k % 20 * 5000 AS BIGINT) AS start, CAST(k % 20 * 5000 + 5000 AS BIGINT) AS stop FROM range(60) t(k))"


def bins(t):
    k = F.col("id").cast("int")
    return t.spark.range(60).select(k.alias("bin"), F.floor(k / 20).cast("int").alias("chr"), (k % 20 * 5000).cast("long").alias("start"), (k % 20 * 5000 + 5000).cast("long").alias("stop"))


@query("point_to_bin", f"WITH {m.POINTS}, {_BINS} SELECT bin, b.chr, start, stop, count(p.pos) AS count FROM bins b LEFT JOIN points p ON p.chr = b.chr AND start <= p.pos AND p.pos < stop GROUP BY ALL")
def _(t):
    """Points per bin, empty bins included."""
    return cn.bin_counts(t.points, bins(t))


@query("equal_mass_bins")
def _(t):
    """Bins of equal total count."""
    return cn.equal_mass_bins(t.points.groupBy("chr", "pos").agg(F.count("*").alias("count")), 50)


@query("normalised_ratio", f"WITH {m.PROFILE}, r AS (SELECT *, CAST(count AS DOUBLE) / (1 + bin % 3) AS raw FROM profile) SELECT sample, bin, round(greatest(0.01, raw / avg(raw) OVER (PARTITION BY sample)), 6) AS ratio FROM r")
def _(t):
    """Ratio to a correction, over its mean."""
    p = t.profile.drop("ratio").withColumn("corr", 1 + F.col("bin") % 3)
    return cn.normalise(p).select("sample", "bin", rounded("ratio").alias("ratio"))


@query("bad_bins_mad", f"""WITH {m.PROFILE}, a AS (SELECT bin, region, list_sort(list(ratio))[count(*) // 2 + 1] AS med FROM profile GROUP BY 1, 2),
s AS (SELECT bin, region, list_sort(list(abs(ratio - med)))[count(*) // 2 + 1] AS spread FROM profile JOIN a USING (bin, region) GROUP BY 1, 2),
u AS (SELECT region, list_sort(list(spread))[count(*) // 2 + 1] AS usual FROM s GROUP BY 1), d AS (SELECT region, usual, list_sort(list(abs(spread - usual)))[count(*) // 2 + 1] AS dev FROM s JOIN u USING (region) GROUP BY 1, 2)
SELECT bin, region, round(spread, 6) AS spread, spread > usual + 2 * dev AS bad FROM s JOIN d USING (region)""")
def _(t):
    """Bins of unusual spread."""
    return cn.bad_bins(t.profile, 2.0).select("bin", "region", rounded("spread").alias("spread"), "bad")


@query("segments", f"""WITH {m.PROFILE}, r AS (SELECT *, CASE WHEN lag(seg_ratio) OVER w = seg_ratio THEN 0 ELSE 1 END AS c FROM profile WINDOW w AS (PARTITION BY sample, chr ORDER BY bin)),
s AS (SELECT *, sum(c) OVER (PARTITION BY sample, chr ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run FROM r) SELECT sample, chr, seg_ratio, min(bin) AS start, max(bin) + 1 AS stop, count(*) AS n_bins, CAST(sum(count) AS BIGINT) AS count FROM s GROUP BY sample, chr, run, seg_ratio""")
def _(t):
    """Segments with their counts."""
    return segments_of(t)


def segments_of(t):
    from ..operators.intervals import overlap_join

    runs = cn.segments(t.profile).select("sample", "chr", "seg_ratio", F.col("first").alias("start"), (F.col("last") + 1).alias("stop"), F.col("n").alias("n_bins"))
    b = t.profile.select("sample", "chr", F.col("bin").alias("start"), (F.col("bin") + 1).alias("stop"), "count")
    met = overlap_join(runs, b, width=12).filter("l_sample = r_sample")
    keys = ["sample", "chr", "seg_ratio", "start", "stop", "n_bins"]
    return met.groupBy(*[F.col(f"l_{k}").alias(k) for k in keys]).agg(F.sum("r_count").alias("count"))


@query("state_calls")
def _(t):
    """Copy states of segments."""
    s = segments_of(t).join(t.profile.groupBy("sample").agg(F.first("median").cast("double").alias("avg")), "sample").withColumn("expected", F.lit(2.0))
    return cn.call_states(s).withColumns({c: rounded(c, 4) for c in ("score", "p_expected")})


@query("state_annotation", f"""WITH {m.GAPS}, {m.GENES} SELECT l.chr, l.start, l.stop, string_agg(g.name, ',' ORDER BY g.name) AS genes FROM (SELECT DISTINCT chr, start, stop FROM gaps) l JOIN genes g ON l.chr = g.chr AND l.start < g.stop AND g.start < l.stop GROUP BY ALL""")
def _(t):
    """Gene names over segments."""
    return cn.annotate_segments(t.gaps.select("chr", "start", "stop").distinct(), t.genes)


def _called(t):
    s = t.profile.select("sample", "chr", F.col("bin").alias("start"), (F.col("bin") + 1).alias("stop"), "count", F.lit(1).alias("n_bins"), (F.col("median") / 2.0).alias("copy1"), F.lit(2.0).alias("expected"))
    return cn.population_calls(s)


@query("population_calls", f"""WITH {m.PROFILE}, f AS (SELECT sample, bin, count / (median / 2.0) AS fcopy FROM profile) SELECT sample, bin, round(fcopy, 6) AS fcopy, CASE WHEN fcopy > 2.5 THEN 'gain' WHEN fcopy < 1.5 THEN 'loss' ELSE 'norm' END AS call FROM f""")
def _(t):
    """Gains and losses (the tail probabilities have their own test)."""
    return _called(t).select("sample", F.col("start").alias("bin"), rounded("fcopy").alias("fcopy"), "call")


@query("population_ranks", f"""WITH {m.PROFILE}, f AS (SELECT sample, chr, bin, count / (median / 2.0) AS fcopy FROM profile), c AS (SELECT *, CASE WHEN fcopy > 2.5 THEN 'gain' WHEN fcopy < 1.5 THEN 'loss' ELSE 'norm' END AS call FROM f)
SELECT sample, bin, CAST(CASE WHEN call = 'loss' THEN rank() OVER (PARTITION BY chr, bin ORDER BY fcopy) ELSE rank() OVER (PARTITION BY chr, bin ORDER BY fcopy DESC) END AS INTEGER) AS pop_rank FROM c""")
def _(t):
    """Rank in the population."""
    return cn.population_ranks(_called(t)).select("sample", F.col("start").alias("bin"), "pop_rank")


@query("pedigree_calls", f"""WITH {m.PROFILE}, {m.SAMPLES}, f AS (SELECT sample, chr, bin, count / (median / 2.0) AS fcopy FROM profile), c AS (SELECT *, CASE WHEN fcopy > 2.5 THEN 'gain' WHEN fcopy < 1.5 THEN 'loss' ELSE 'norm' END AS call FROM f),
o AS (SELECT * FROM c JOIN samples USING (sample)) SELECT k.sample, k.bin, k.call, EXISTS (SELECT 1 FROM o p WHERE p.relation = 'parent' AND p.family = k.family AND p.bin = k.bin AND (p.call = k.call OR abs(p.fcopy - k.fcopy) <= 0.25)) AS transmitted FROM o k WHERE relation = 'child' AND call <> 'norm'""")
def _(t):
    """Transmitted and new events of children."""
    return cn.pedigree_calls(_called(t), t.samples).select("sample", F.col("start").alias("bin"), "call", "transmitted")


@query("denovo_cn", f"""WITH {m.PROFILE}, {m.SAMPLES}, s AS (SELECT sample, family, relation, chr, bin AS start, bin + 1 AS stop, count / (median / 2.0) AS cn, CAST(bin % 12 AS DOUBLE) AS score FROM profile JOIN samples USING (sample))
SELECT sample, start, round(cn, 6) AS cn FROM s k WHERE relation = 'child' AND score > 7 AND abs(cn - 2) > 0.6 AND NOT EXISTS (SELECT 1 FROM s p WHERE p.relation = 'parent' AND p.family = k.family AND p.chr = k.chr AND p.start < k.stop AND k.start < p.stop AND abs(p.cn - k.cn) < 0.4)""")
def _(t):
    """New segments in families."""
    s = t.profile.join(t.samples, "sample").select("sample", "family", "relation", "chr", F.col("bin").alias("start"), (F.col("bin") + 1).alias("stop"), (F.col("count") / (F.col("median") / 2.0)).alias("cn"), F.lit(2.0).alias("expected"), (F.col("bin") % 12).cast("double").alias("score"))
    return cn.denovo_events(s.filter("relation = 'child'"), s.filter("relation = 'parent'")).select("sample", "start", rounded("cn").alias("cn"))


@query("recurrent_cn", f"""WITH {m.INTERVALS}, s AS (SELECT chr, start, stop, type FROM intervals), b AS (SELECT *, unnest(range(start // 1000, (stop - 1) // 1000 + 1)) AS bin FROM s WHERE stop - start < 1000000),
d AS (SELECT type, chr, bin, sum(least(stop, (bin + 1) * 1000) - greatest(start, bin * 1000)) / 1000.0 AS depth FROM b GROUP BY ALL), f AS (SELECT type, chr, bin, max(depth) AS depth FROM (SELECT * FROM d UNION ALL SELECT type, chr, bin + 1, 0.0 FROM d) GROUP BY ALL),
h AS (SELECT *, CASE WHEN depth > 5 THEN 1 WHEN depth < 5 THEN 0 END AS st0 FROM f), h2 AS (SELECT *, coalesce(last_value(st0 IGNORE NULLS) OVER (PARTITION BY type, chr ORDER BY bin ROWS UNBOUNDED PRECEDING), 0) AS st FROM h),
c AS (SELECT *, CASE WHEN lag(st) OVER (PARTITION BY type, chr ORDER BY bin) = st THEN 0 ELSE 1 END AS ch FROM h2), r AS (SELECT *, sum(ch) OVER (PARTITION BY type, chr ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run FROM c),
g AS (SELECT type, chr, run, st, min(bin) AS start, max(depth) AS height FROM r GROUP BY ALL), l AS (SELECT *, lead(start) OVER (PARTITION BY type, chr ORDER BY run) AS stop FROM g)
SELECT type AS call, chr, CAST(start * 1000 AS BIGINT) AS start, CAST(stop * 1000 AS BIGINT) AS stop, round(height, 6) AS height FROM l WHERE st = 1 AND stop IS NOT NULL""")
def _(t):
    """Recurrent regions, by depth and peaks."""
    return cn.recurrent_regions(t.intervals.withColumnRenamed("type", "call")).withColumn("height", rounded("height"))


@query("chromosome_means", f"WITH {m.PROFILE} SELECT sample, chr, round(avg(ratio), 6) AS mean_ratio, count(*) AS n_bins FROM profile GROUP BY 1, 2")
def _(t):
    """Mean ratio per chromosome."""
    return cn.chromosome_means(t.profile).withColumn("mean_ratio", rounded("mean_ratio"))


@query("sample_deviation", f"WITH {m.PROFILE} SELECT sample, round(sum(abs(ratio * 2 - 2)) / count(*), 6) AS deviation, count(*) FILTER (abs(ratio * 2 - 2) >= 0.5) AS n_drawn FROM profile GROUP BY 1")
def _(t):
    """Weighted deviation of a sample."""
    return cn.deviation(t.profile.select("sample", F.lit(1).alias("n_bins"), (F.col("ratio") * 2).alias("cn"), F.lit(2).alias("norm"))).withColumn("deviation", rounded("deviation"))


@query("noise_report", f"""WITH {m.PROFILE}, l AS (SELECT *, lag(ratio) OVER w AS earlier, CASE WHEN lag(seg_ratio) OVER w IS NOT DISTINCT FROM seg_ratio THEN 0 ELSE 1 END AS new FROM profile WINDOW w AS (PARTITION BY sample, region ORDER BY bin)),
a AS (SELECT sample, region, count(*) AS n_bins, round(avg(ratio), 6) AS mean, round(stddev_pop(ratio), 6) AS stdev, CAST(sum(new) AS BIGINT) AS n_segments, list_sort(list(ratio))[count(*) // 2 + 1] AS median FROM l GROUP BY 1, 2)
SELECT a.*, list_sort(list(abs(ratio - median)))[count(*) // 2 + 1] AS mad FROM a JOIN profile USING (sample, region) GROUP BY ALL""".replace("AS median FROM l GROUP BY 1, 2)\nSELECT a.*", "AS med FROM l GROUP BY 1, 2)\nSELECT a.* EXCLUDE (med), round(med, 6) AS median").replace("list(abs(ratio - median))", "list(abs(ratio - med))").replace("list_sort(list(abs(ratio - med)))[count(*) // 2 + 1] AS mad", "round(list_sort(list(abs(ratio - med)))[count(*) // 2 + 1], 6) AS mad"))
def _(t):
    """Noise of a profile per region."""
    return cn.noise_report(t.profile).select("sample", "region", "n_bins", rounded("mean").alias("mean"), rounded("stdev").alias("stdev"), "n_segments", rounded("median").alias("median"), rounded("mad").alias("mad"))


@query("sex_by_density", f"""WITH {m.PROFILE}, d AS (SELECT sample, avg(ratio) FILTER (region = 'auto') AS a, coalesce(avg(ratio) FILTER (region = 'X'), 0) / 2 AS x, coalesce(avg(ratio) FILTER (region = 'Y'), 0) / 4 AS y FROM profile GROUP BY 1)
SELECT sample, CAST(greatest(0, ceil(2.2 * x / a)) AS INTEGER) AS n_x, CAST(greatest(0, ceil(2.2 * y / a)) AS INTEGER) AS n_y, repeat('X', CAST(greatest(0, ceil(2.2 * x / a)) AS INTEGER)) || repeat('Y', CAST(greatest(0, ceil(2.2 * y / a)) AS INTEGER)) AS sex FROM d""")
def _(t):
    """Sex by density."""
    r = lambda x: F.avg(F.when(F.col("region") == x, F.col("ratio")))
    d = t.profile.groupBy("sample").agg(r("auto").alias("auto"), (F.coalesce(r("X"), F.lit(0)) / 2).alias("x"), (F.coalesce(r("Y"), F.lit(0)) / 4).alias("y"))
    return cn.sex_copies(d).select("sample", "n_x", "n_y", "sex")


@query("sex_by_ratio", f"WITH {m.PROFILE}, y AS (SELECT sample, avg(ratio) FILTER (region = 'Y') AS y FROM profile GROUP BY 1) SELECT sample, round(y, 6) AS y_ratio, CASE WHEN y > 0.3333 THEN 'XY' ELSE 'XX' END AS sex FROM y")
def _(t):
    """Sex by the mean Y ratio."""
    return cn.sex_by_ratio(t.profile).withColumn("y_ratio", rounded("y_ratio"))


@query("stable_bins", f"""WITH {m.PROFILE}, s AS (SELECT bin, region, max(ratio) - min(ratio) AS range FROM profile GROUP BY 1, 2), u AS (SELECT region, list_sort(list(range))[count(*) // 2 + 1] AS usual FROM s GROUP BY 1)
SELECT bin, region, round(range, 6) AS range FROM s JOIN u USING (region) WHERE range <= usual""")
def _(t):
    """Bins that vary little."""
    return cn.stable_bins(t.profile).select("bin", "region", rounded("range").alias("range"))


@query("usual_bins", """WITH b AS (SELECT p_partkey, p_size, p_retailprice FROM part), m AS (SELECT list_sort(list(p_size))[count(*) // 2 + 1] AS a FROM b), d AS (SELECT a, list_sort(list(abs(p_size - a)))[count(*) // 2 + 1] AS k FROM b, m GROUP BY a), c AS (SELECT b.* FROM b, d WHERE abs(p_size - a) <= k),
m2 AS (SELECT list_sort(list(p_retailprice))[count(*) // 2 + 1] AS a FROM c), d2 AS (SELECT a, list_sort(list(abs(p_retailprice - a)))[count(*) // 2 + 1] AS k FROM c, m2 GROUP BY a) SELECT c.p_partkey FROM c, d2 WHERE abs(p_retailprice - a) <= 0.5 * k""")
def _(t):
    """Bins within some deviations of the medians, cut after cut."""
    return cn.usual_bins(t.part.select("p_partkey", "p_size", "p_retailprice"), {"p_size": 1.0, "p_retailprice": 0.5}).select("p_partkey")


@query("quantal_multiplier", f"""WITH {m.PROFILE}, g AS (SELECT 1.5 + k * 0.05 AS multiplier FROM range(81) t(k)), e AS (SELECT sample, multiplier, round(sum(power(seg_ratio * multiplier - round(seg_ratio * multiplier), 2)), 9) AS error FROM profile, g GROUP BY 1, 2)
SELECT sample, round(arg_min(multiplier, error + multiplier * 1e-9), 4) AS multiplier FROM e GROUP BY 1""")
def _(t):
    """The multiplier that makes segment ratios whole."""
    return cn.quantal(t.profile).withColumn("multiplier", rounded("multiplier", 4))


@query("merged_fragments", f"""WITH {m.MUMS}, d AS (SELECT *, CASE WHEN flipped THEN pos + off + len ELSE pos - off END AS diagonal FROM mums)
SELECT pair_id, read_2, chr, flipped, CAST(sum(len) AS BIGINT) AS total_len, count(*) AS n FROM d GROUP BY pair_id, read_2, chr, flipped, diagonal""")
def _(t):
    """Matches on one diagonal become a fragment."""
    return cn.merge_fragments(t.mums).select("pair_id", "read_2", "chr", "flipped", "total_len", "n")


@query("distinct_fragments", f"""WITH {m.MUMS}, k AS (SELECT pair_id, list_sort(list({{'c': chr, 's': pos - off}})) AS key FROM mums GROUP BY 1), f AS (SELECT key, min(pair_id) AS pair_id FROM k GROUP BY 1) SELECT pair_id, ord FROM mums SEMI JOIN f USING (pair_id)""")
def _(t):
    """Pairs with equal fragments count once."""
    return cn.distinct_fragments(t.mums).select("pair_id", "ord")


@query("lowess")
def _(t):
    """Robust smoothing of a profile."""
    return models.lowess(t.profile, ["sample"], "bin", "bin", "ratio", 0.3, 3, 0.0).select("sample", "bin", rounded("smooth").alias("smooth"))


@query("cbs")
def _(t):
    """Circular binary segmentation."""
    return models.segment(t.profile, ["sample"], "bin", "ratio")


@query("hmm")
def _(t):
    """Hidden Markov states."""
    p = t.profile.withColumn("level", F.least(F.lit(2), F.floor("ratio")).cast("int"))
    move = [[0.9, 0.08, 0.02], [0.05, 0.9, 0.05], [0.02, 0.08, 0.9]]
    return models.hmm_states(p, ["sample"], "bin", "level", [0.2, 0.6, 0.2], move, [[0.8, 0.15, 0.05], [0.1, 0.8, 0.1], [0.05, 0.15, 0.8]]).select("sample", "bin", "state")


@query("knn", """SELECT query_id, point_id, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS point_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS rank
FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 5""")
def _(t):
    """Nearest neighbours of a stated query set against all vectors."""
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return models.nearest_neighbours(v.filter("id % 20 = 0"), v, 5).select("query_id", "point_id", "rank")


@query("grid_density", """WITH g AS (SELECT DISTINCT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) / 10 AS y FROM part) SELECT a.id, count(*) AS density FROM g a JOIN g b ON power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 9 GROUP BY 1""")
def _(t):
    """Density by grid cells."""
    g = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 10).alias("y"))
    return models.grid_density(g, "x", "y", 3.0, 3.0).groupBy("id").agg(F.sum("density").alias("density"))


_U = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) / 4503599627370496.0"


@query("simulated_mixture", f"WITH r AS (SELECT s AS sample, CAST(b AS INTEGER) AS bin, CASE WHEN b BETWEEN 50 AND 80 THEN 2 * 0.5 + 3 * 0.5 ELSE 2.0 END * 100 / 2 AS expected, 1 - {_U.format("concat_ws('|', 1, 1, s, b)")} AS u, 1 - {_U.format("concat_ws('|', 1, 2, s, b)")} AS v FROM range(10) t(s), range(200) w(b)) "
       "SELECT sample, bin, CAST(expected AS DOUBLE) AS expected, CAST(greatest(0, round(expected + sqrt(expected) * sqrt(-2 * ln(u)) * cos(2 * pi() * v))) AS BIGINT) AS count FROM r")
def _(t):
    """Counts of a simulated mixture."""
    return cn.simulate_mixture(t.spark, 200, 10, 0.5, (50, 80, 3))


@query("simulated_events", f"""WITH genome AS (SELECT CAST(r_regionkey AS INTEGER) AS chr, CAST(2000 * (r_regionkey + 1) AS BIGINT) AS len, coalesce(sum(2000 * (r_regionkey + 1)) OVER (ORDER BY r_regionkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM region WHERE r_regionkey < 3),
e AS (SELECT i AS id, CAST(floor({_U.format("'9|' || i")} * (SELECT sum(len) FROM genome)) AS BIGINT) AS abspos, CAST(floor({_U.format("'10|' || i")} * 500) + 1 AS BIGINT) AS size, ['deletion', 'insertion', 'inversion', 'translocation'][CAST(floor({_U.format("'11|' || i")} * 4) AS INTEGER) + 1] AS type FROM range(300) t(i)),
f AS (SELECT CAST(i AS INTEGER) AS family, m AS member, i || '-' || m AS sample FROM range(20) t(i), (SELECT unnest(['mother', 'father', 'proband', 'sibling']) AS m)), k AS (SELECT *, CAST('0x' || substr(md5('0|' || sample), 1, 7) AS BIGINT) % 300 AS k FROM f)
SELECT id, chr, CAST(abspos - o AS BIGINT) AS start, CAST(abspos - o + size AS BIGINT) AS stop, type, sample FROM e JOIN genome ON o <= abspos AND abspos < o + len LEFT JOIN k ON id = k.k""")
def _(t):
    """Simulated events and families."""
    e = simulate.simulate_events(t.spark, 300, t.chromosomes, 500, 9)
    f = simulate.families(t.spark, 20, 9).withColumn("k", F.conv(F.substring(F.md5(F.concat(F.lit("0|"), "sample").cast("binary")), 1, 7), 16, 10).cast("long") % 300)
    return e.join(f, F.col("id") == F.col("k"), "left").select("id", "chr", "start", "stop", "type", "sample")
