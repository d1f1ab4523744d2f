"""Queries of matches, bridges and pedigrees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coords
from ..operators import bridges as br
from ..operators import pedigree as pd_
from . import model as m
from .interval_queries import _MAPPA, mappa
from .model import rounded
from .registry import query

SIG = br.SIGNATURE
_S = m.SIG
#: The driver tables' bridges repeat at most a few times, so test queries lower the counts, not the rules.
CUTS = pd_.Cuts(exclude_snps=True, min_support=20, min_bridge_count=2)


@query("pair_mums", f"WITH {m.PAIRS} SELECT pair_id, ord, chr, pos, off, len, read_len, sample FROM mums JOIN pairs USING (pair_id)")
def _(t):
    """Pairs with their matches."""
    return t.mums.join(t.pairs, "pair_id").select("pair_id", "ord", "chr", "pos", "off", "len", "read_len", "sample")


@query("first_mums", f"WITH {m.MUMS} SELECT pair_id, read_2, chr, pos FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, read_2 ORDER BY ord) AS k FROM mums) WHERE k = 1")
def _(t):
    """First match of each read."""
    return br.first_mums(t.mums).select("pair_id", "read_2", "chr", "pos")


@query("dupe_marking", f"WITH {m.DUPES} SELECT pair_id, sample, dupe FROM marked")
def _(t):
    """Duplicate pairs."""
    return t.marked_pairs.select("pair_id", "sample", "dupe")


@query("read_positions", f"WITH {m.MUMS} SELECT pair_id, ord, {m.READPOS} AS readpos, CASE WHEN flipped THEN pos ELSE pos + len - 1 END AS anchor FROM mums")
def _(t):
    """Section 2.8: coordinates of matches in reads."""
    anchor = coords.anchor_position(F.col("pos"), F.col("len"), ~F.col("flipped"))
    return br.with_read_position(t.mums).select("pair_id", "ord", "readpos", anchor.alias("anchor"))


@query("adjacent_mums", f"WITH {m.MUMS} SELECT pair_id, ord, lag(pos) OVER w AS before, lead(pos) OVER w AS after FROM mums WINDOW w AS (PARTITION BY pair_id, read_2 ORDER BY ord)")
def _(t):
    """Neighbours in the read."""
    from pyspark.sql import Window

    w = Window.partitionBy("pair_id", "read_2").orderBy("ord")
    return t.mums.select("pair_id", "ord", F.lag("pos").over(w).alias("before"), F.lead("pos").over(w).alias("after"))


@query("read_support", f"WITH {m.SUPPORT} SELECT pair_id, ord, CAST(low_s AS INTEGER) AS low_support, CAST(high_s AS INTEGER) AS high_support FROM support")
def _(t):
    """Co-linear support on either side."""
    return br.read_support(t.mums).select("pair_id", "ord", "low_support", "high_support")


_FOLD = "{{'n': {}, 'lo': {}, 'hi': {}, 'chr': x.chr, 'pos': x.pos, 'len': x.len, 'flipped': x.flipped}}"


@query("mate_support", f"""WITH {m.MUMS}, rp AS (SELECT *, {m.READPOS} AS readpos FROM mums), s AS (SELECT *, min(pos) OVER g AS seen_low, max(pos + len - 1) OVER g AS seen_high FROM rp WINDOW g AS (PARTITION BY pair_id, read_2, chr, flipped, readpos)),
mt AS (SELECT pair_id, NOT read_2 AS read_2, list({{'n': CAST(0 AS BIGINT), 'lo': pos, 'hi': pos, 'chr': chr, 'pos': pos, 'len': len, 'flipped': flipped}} ORDER BY ord DESC) AS mates FROM mums GROUP BY 1, 2),
j AS (SELECT s.pair_id, s.ord, s.chr, s.pos, s.flipped, [{{'n': CAST(0 AS BIGINT), 'lo': seen_low, 'hi': CAST(seen_high AS BIGINT), 'chr': s.chr, 'pos': s.pos, 'len': s.len, 'flipped': s.flipped}}] || coalesce(mates, []) AS xs FROM s LEFT JOIN mt USING (pair_id, read_2))
SELECT pair_id, ord, list_reduce(xs, lambda a, x: CASE WHEN x.chr = j.chr AND x.flipped <> j.flipped AND CASE WHEN j.flipped THEN NOT (x.pos >= a.lo OR j.pos > x.pos + 1000) ELSE NOT (x.pos + x.len - 1 <= a.hi OR x.pos > j.pos + 1000) END
  THEN {_FOLD.format("CAST(a.n + CASE WHEN j.flipped THEN least(a.lo, x.pos + x.len) - x.pos ELSE x.pos + x.len - greatest(a.hi + 1, x.pos) END AS BIGINT)", "least(a.lo, x.pos)", "CAST(greatest(a.hi, x.pos + x.len - 1) AS BIGINT)")} ELSE a END).n AS mate_support FROM j""")
def _(t):
    """Bases that the mate adds, an ordered fold."""
    return br.mate_support(br.read_support(t.mums)).select("pair_id", "ord", "mate_support")


@query("bridges_pair", f"WITH {m.BRIDGES} SELECT pair_id, {_S}, anchor1_len, anchor2_len FROM observed")
def _(t):
    """Bridges of each pair."""
    return t.observed_bridges.select("pair_id", *SIG, "anchor1_len", "anchor2_len")


@query("bridges_sample", f"WITH {m.BRIDGES} SELECT * FROM bridges")
def _(t):
    """A2: bridges of each sample."""
    return t.sample_bridges.select("sample", *SIG, "bridge_count", "anchor1_len", "anchor2_len")


@query("bridges_merged", f"WITH {m.BRIDGES} SELECT * FROM bridges")
def _(t):
    """Bridge tables of parts of a sample merged to that of the whole."""
    o = t.observed_bridges
    return br.combine_bridges([br.sample_bridges(o.filter("pair_id % 2 = 0")), br.sample_bridges(o.filter("pair_id % 2 <> 0"))]).select("sample", *SIG, "bridge_count", "anchor1_len", "anchor2_len")


_LADDER = "CASE " + " ".join(f"WHEN size <= {n} THEN '{k}'" for n, k in coords.SIZE_CLASSES) + " ELSE '100Ms' END"


@query("bridges_description", f"""WITH {m.BRIDGES}, d AS (SELECT *, {m.INV} AS inv, CASE WHEN {m.INV} = 0 OR high1 = high2 THEN abs(pos1 - pos2) ELSE abs({m.INV}) END AS size FROM bridges)
SELECT sample, {_S}, CAST(inv AS BIGINT) AS inv, CASE WHEN high1 <> high2 THEN '=' WHEN high1 THEN 'i' ELSE 'o' END AS orientation, CASE WHEN chr1 <> chr2 THEN 'translocation' ELSE
  CASE WHEN high1 <> high2 AND inv = 0 AND size <= 2 THEN 'single' ELSE {_LADDER} END || ' ' || CASE WHEN high1 = high2 AND high1 THEN 'inversion' WHEN high1 = high2 THEN 'outversion' WHEN inv = 0 THEN 'substitution' WHEN inv > 0 THEN 'insertion' ELSE 'deletion' END END AS description FROM d""")
def _(t):
    """Section 2.8: invariant, orientation and description."""
    c = [F.col(x) for x in SIG]
    return t.sample_bridges.select("sample", *SIG, br.bridge_invariant().cast("long").alias("inv"), coords.orientation(F.col("high1"), F.col("high2")).alias("orientation"), coords.describe(*c).alias("description"))


@query("population_database", f"WITH {m.POPULATION} SELECT {_S}, n_people, n_bridges, median_bridges, max_bridges FROM population")
def _(t):
    """A3: bridges among unrelated samples (the flagship query)."""
    return br.population_database(t.sample_bridges, t.samples)


@query("pop_left_join", f"WITH {m.POPULATION} SELECT sample, {_S}, bridge_count, coalesce(n_people, 0) AS pop_n_people, coalesce(p.n_bridges, 0) AS pop_n_bridges FROM bridges LEFT JOIN population p USING ({_S})")
def _(t):
    """Left join with the population table."""
    b = t.sample_bridges
    return br.with_population(b, br.population_database(b, t.samples)).select("sample", *SIG, "bridge_count", "pop_n_people", "pop_n_bridges")


@query("bridge_mappability", f"""WITH {m.BRIDGES}, {_MAPPA} SELECT sample, {_S}, a.low AS low1, a.high AS high_map1, b.low AS low2, b.high AS high_map2, anchor1_len - CASE WHEN high1 THEN a.high ELSE a.low END AS excess1
FROM bridges LEFT JOIN mappa a ON chr1 = a.chr AND pos1 = a.pos LEFT JOIN mappa b ON chr2 = b.chr AND pos2 = b.pos""")
def _(t):
    """Mappability of both anchors."""
    return br.with_mappability(t.sample_bridges, mappa(t)).select("sample", *SIG, "low1", "high_map1", "low2", "high_map2", "excess1")


@query("families_seen", f"""WITH {m.COHORT} SELECT {_S}, count(DISTINCT family) AS n_families, count(*) AS n_samples, CAST(sum(bridge_count) AS BIGINT) AS total, CAST(coalesce(sum(bridge_count) FILTER (relation = 'parent'), 0) AS BIGINT) AS parent_total,
CAST(coalesce(sum(bridge_count) FILTER (relation <> 'parent'), 0) AS BIGINT) AS child_total FROM bridges JOIN samples USING (sample) GROUP BY ALL""")
def _(t):
    """Families, samples and conditional totals."""
    return pd_.families_seen(t.sample_bridges, t.samples)


@query("family_maxima", f"WITH {m.COHORT} SELECT {_S}, family, max(bridge_count) AS bridge_count, max(anchor1_len) AS anchor1_len, count(*) FILTER (relation = 'parent') AS n_parents, count(*) FILTER (relation <> 'parent') AS n_children FROM bridges JOIN samples USING (sample) GROUP BY ALL")
def _(t):
    """A5: maxima per family."""
    return pd_.family_maxima(t.sample_bridges, t.samples).select(*SIG, "family", "bridge_count", "anchor1_len", "n_parents", "n_children")


_FAM = f"""WITH {m.COHORT}, rows_ AS (SELECT * FROM bridges JOIN samples USING (sample) WHERE {m.INV} <> 0),
seen AS (SELECT {_S}, count(DISTINCT family) AS n_families, count(*) AS n_samples FROM rows_ GROUP BY ALL),
fam AS (SELECT {_S}, family, max(bridge_count) AS bridge_count, max(anchor1_len) AS a1, max(anchor2_len) AS a2, count(*) FILTER (relation = 'parent') AS n_parents FROM rows_ GROUP BY ALL)
SELECT {_S}, family, bridge_count, n_families FROM fam JOIN seen USING ({_S}) WHERE n_parents <= 1 AND bridge_count >= 2 AND a1 >= 20 AND a2 >= 20 AND """
_MODES = {
    "rare_denovo": "n_families <= 5 AND n_parents = 0", "ultra_rare_denovo": "n_samples <= 2 AND n_families = 1 AND n_parents = 0", "denovo": "n_parents = 0", "ultra_rare": "n_families = 1",
    "ultra_rare_and_denovo": "NOT (n_families > 1 AND n_parents > 0)",
}
for _mode, _cond in _MODES.items():

    @query(f"{_mode}_cut", _FAM + _cond)
    def _(t, mode=_mode):
        """D8, A5, section 2.12: candidates of a study mode."""
        return pd_.candidates(t.sample_bridges, t.samples, mode, CUTS).select(*SIG, "family", "bridge_count", "n_families")


@query("denovo_anti_join", f"WITH {m.COHORT}, o AS (SELECT * FROM bridges JOIN samples USING (sample)) SELECT {_S}, family, sample FROM o c WHERE relation = 'child' AND NOT EXISTS (SELECT 1 FROM o p WHERE p.relation = 'parent' AND p.family = c.family AND "
       + " AND ".join(f'p."{c}" = c."{c}"' for c in SIG) + ")")
def _(t):
    """children's bridges without a parent's."""
    return pd_.denovo(t.sample_bridges, t.samples).select(*SIG, "family", "sample")


@query("max_other_family", f"""WITH {m.COHORT}, f AS (SELECT {_S}, family, max(bridge_count) AS bridge_count FROM bridges JOIN samples USING (sample) GROUP BY ALL)
SELECT a.*, coalesce((SELECT max(b.bridge_count) FROM f b WHERE b.family <> a.family AND {" AND ".join(f'a."{c}" = b."{c}"' for c in SIG)}), 0) AS max_other FROM f a""")
def _(t):
    """Highest count outside the family."""
    return pd_.max_other_family(t.sample_bridges, t.samples)


@query("transmission_table", f"""WITH {m.COHORT}, f AS (SELECT {_S}, family, max(bridge_count) FILTER (relation = 'parent') AS parent_max, min(bridge_count) FILTER (relation = 'parent') AS parent_min, count(*) FILTER (relation = 'parent') AS n_parents,
  count(*) FILTER (relation = 'child' AND sex = 'XX') AS daughters, count(*) FILTER (relation = 'child' AND sex = 'XY') AS sons FROM bridges JOIN samples USING (sample) GROUP BY ALL)
SELECT * FROM f WHERE parent_max >= 2 AND (n_parents < 2 OR parent_min <= 1)""")
def _(t):
    """Transmission from one parent."""
    return pd_.transmission(t.sample_bridges, t.samples, 2, 1)


@query("member_counts", f"WITH {m.COHORT} SELECT member, sex, count(*) AS n_bridges, CAST(sum(bridge_count) AS BIGINT) AS n_pairs, max(bridge_count) AS max_bridge FROM bridges JOIN samples USING (sample) GROUP BY 1, 2")
def _(t):
    """Counts by member and sex."""
    return pd_.member_counts(t.sample_bridges, t.samples)


@query("anchor_predicate", f"""WITH {m.MUMS} SELECT pair_id, ord FROM mums WHERE chr = 1 AND NOT flipped AND pos + len - 1 = 420 AND off + len < read_len
UNION ALL SELECT pair_id, ord FROM mums WHERE chr = 1 AND flipped AND pos + len - 1 = 420 AND off > 0""")
def _(t):
    """Matches that anchor at a position."""
    return br.anchors_at(t.mums, 1, 420, True).select("pair_id", "ord")


@query("bridge_lookup", f"""WITH {m.MUMS}, a AS (SELECT pair_id, read_2, ord, off, len FROM mums WHERE chr = 1 AND pos + len - 1 = 420 AND CASE WHEN flipped THEN off > 0 ELSE off + len < read_len END),
b AS (SELECT pair_id, read_2, ord, off, len FROM mums WHERE chr = 0 AND pos = 900 AND CASE WHEN flipped THEN off + len < read_len ELSE off > 0 END),
j AS (SELECT pair_id, a.ord AS a_ord, b.ord AS b_ord, CASE WHEN a.ord < b.ord THEN b.off - (a.off + a.len - 1) ELSE a.off - (b.off + b.len - 1) END AS "offset" FROM a JOIN b USING (pair_id, read_2) WHERE a.ord <> b.ord)
SELECT pair_id, a_ord, b_ord FROM j WHERE 420 - 900 + "offset" = -478""")
def _(t):
    """Pairs with a given bridge."""
    return br.lookup_bridge(t.mums, (1, 420, True), (0, 900, False), -478).select("pair_id", "a_ord", "b_ord")


@query("bridges_exist", f"WITH {m.BRIDGES}, w AS (SELECT DISTINCT {_S} FROM bridges WHERE sample = 3) SELECT sample, {_S}, bridge_count FROM bridges SEMI JOIN w USING ({_S})")
def _(t):
    """Bridges that another list holds."""
    b = t.sample_bridges
    return b.join(b.filter("sample = 3").select(*SIG).distinct(), SIG, "left_semi").select("sample", *SIG, "bridge_count")


_Q = lambda c, a: f'{a}."{c}"'


@query("similar_bridge", f"""WITH {m.BRIDGES}, i AS (SELECT *, {m.INV} AS inv FROM bridges), w AS (SELECT DISTINCT {_S}, inv FROM i WHERE sample = 3)
SELECT DISTINCT b.sample, {", ".join(_Q(c, "b") for c in SIG)} FROM i b JOIN w ON b.chr1 = w.chr1 AND b.chr2 = w.chr2 AND b.high1 = w.high1 AND b.high2 = w.high2 AND abs(b.pos1 - w.pos1) <= 3 AND abs(b.inv - w.inv) <= 5 WHERE b.sample <> 3""")
def _(t):
    """Bridges near a wanted one."""
    b = t.sample_bridges
    return br.similar_bridges(b.filter("sample <> 3"), b.filter("sample = 3").select(*SIG).distinct(), 3, 5).select("sample", *SIG).distinct()


@query("simple_events", f"WITH {m.BRIDGES} SELECT sample, {_S} FROM bridges WHERE {m.INV} <> 0 AND abs({m.INV}) <= 1000000 AND chr1 = chr2 AND high1 <> high2")
def _(t):
    """Insertions and deletions."""
    return br.simple_events(t.sample_bridges).select("sample", *SIG)


@query("pseudogene_junctions", f"""WITH {m.BRIDGES}, j AS (SELECT CAST(p_partkey % 3 AS INTEGER) AS chr, CAST((p_partkey % 12) * 100 + 20 AS BIGINT) AS stop, CAST(p_size * 20 AS BIGINT) AS l FROM part),
b AS (SELECT DISTINCT {_S}, {m.INV} AS inv FROM bridges WHERE chr1 = chr2 AND high1 <> high2 AND {m.INV} < 0)
SELECT {_S} FROM b WHERE EXISTS (SELECT 1 FROM j WHERE chr = chr1 AND (abs(pos1 - stop) <= 20 OR abs(pos2 - stop) <= 20) AND abs(inv + l) <= 20)""")
def _(t):
    """Bridges that look like spliced copies."""
    j = t.part.select((F.col("p_partkey") % 3).cast("int").alias("chr"), ((F.col("p_partkey") % 12) * 100 + 20).alias("stop"), (F.col("p_size") * 20).cast("long").alias("intron_length"))
    return br.pseudogene_bridges(t.sample_bridges.select(*SIG).distinct(), j).select(*SIG)


@query("cn_mum_selection", f"""WITH {m.DUPES}, {_MAPPA}, b AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY len DESC, ord) AS k FROM mums)
SELECT pair_id, b.chr, b.pos, len FROM b JOIN marked USING (pair_id) JOIN mappa m ON b.chr = m.chr AND b.pos = m.pos WHERE k = 1 AND NOT dupe AND len >= 20 AND least(low, high) <= 25 AND len - least(low, high) >= 1""")
def _(t):
    """One match per pair for copy number."""
    return br.select_cn_mums(t.mums, t.marked_pairs, mappa(t), 20, 1, 25).select("pair_id", "chr", "pos", "len")


@query("coverage_at", f"""WITH {m.MUMS}, p AS (SELECT DISTINCT chr, pos + 5 AS pos FROM mums) SELECT p.chr, p.pos, count(*) AS n_mums, count(DISTINCT pair_id) AS n_pairs FROM p JOIN mums u ON u.chr = p.chr AND u.pos <= p.pos AND p.pos < u.pos + u.len GROUP BY 1, 2""")
def _(t):
    """Matches and distinct pairs over positions."""
    return br.coverage_at(t.placed, t.placed.select("chr", (F.col("pos") + 5).alias("pos")).distinct())


@query("anchor_counts", f"""WITH {m.MUMS}, s AS (SELECT pair_id, chr, len, pos AS a, unnest(range(pos, pos + len)) AS pos FROM mums)
SELECT chr, pos, count(DISTINCT pair_id) FILTER (pos <> a AND pos <> a + len - 1) AS reference, count(DISTINCT pair_id) FILTER (pos = a) AS low_anchor, count(DISTINCT pair_id) FILTER (pos = a + len - 1) AS high_anchor, max(len) AS max_support FROM s GROUP BY 1, 2""")
def _(t):
    """Reference and anchor counts per base."""
    return br.anchor_counts(t.placed)


@query("mappable_coverage", f"""WITH {m.MUMS}, {_MAPPA}, s AS (SELECT chr, len, unnest(range(pos, pos + len)) AS pos FROM mums)
SELECT s.chr, s.pos, count(*) AS n, count(*) FILTER (low + 8 <= len) AS n_low, count(*) FILTER (high + 8 <= len) AS n_high FROM s JOIN mappa m ON s.chr = m.chr AND s.pos = m.pos GROUP BY 1, 2""")
def _(t):
    """Coverage under a mappability condition."""
    s = t.placed.select("chr", "len", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1)).alias("pos"))
    return s.join(mappa(t), ["chr", "pos"]).groupBy("chr", "pos").agg(F.count("*").alias("n"), F.count_if(F.col("low") + 8 <= F.col("len")).alias("n_low"), F.count_if(F.col("high") + 8 <= F.col("len")).alias("n_high"))


@query("unequal_counts")
def _(t):
    """Bridges whose counts differ between samples (Poisson tails)."""
    n = t.pairs.groupBy("sample").agg(F.count("*").alias("n_pairs"))
    return br.unequal_bridges(t.sample_bridges, n, 5, 0.5).withColumn("p", rounded("p"))


@query("incidental_split", f"""WITH {m.BRIDGES} SELECT sample, {_S}, bridge_count, row_number() OVER (PARTITION BY sample, chr1, pos1, high1 ORDER BY bridge_count DESC, chr2, pos2, high2, "offset") = 1 AS "real" FROM bridges""")
def _(t):
    """Real and incidental bridges of an anchor, in every sample."""
    return br.incidental_split(t.sample_bridges, ["sample"]).select("sample", *SIG, "bridge_count", "real")


@query("bridge_genes", f"""WITH {m.BRIDGES}, {m.GENES}, a AS (SELECT DISTINCT chr1 AS chr, pos1 AS pos FROM bridges) SELECT a.chr, a.pos, string_agg(g.name, ',' ORDER BY g.name) AS genes,
bool_or(len(list_filter(g.exons, lambda e: e.a <= a.pos AND a.pos < e.b)) > 0) AS in_exon FROM a JOIN genes g ON a.chr = g.chr AND g.start < a.pos AND a.pos < g.stop GROUP BY 1, 2""")
def _(t):
    """Genes and exons at anchors."""
    from ..operators.intervals import genes_at_points

    hit = genes_at_points(t.sample_bridges.select(F.col("chr1").alias("chr"), F.col("pos1").alias("pos")).distinct(), t.genes)
    exon = F.exists("r_exons", lambda e: (e["start"] <= F.col("pos")) & (F.col("pos") < e["stop"]))
    return hit.groupBy("chr", "pos").agg(F.array_join(F.sort_array(F.collect_set("r_name")), ",").alias("genes"), F.bool_or(exon).alias("in_exon"))
