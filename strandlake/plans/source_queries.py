"""Queries of the readers of annotation, copy-number and integer files, and of helpers on text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import cn
from ..sources import readers as rd
from ..sources import writers as wr
from . import model as m
from .format_queries import _SEQS, scratch, seqs, text_file
from .interval_queries import _MAPPA, mappa
from .model import rounded
from .registry import query


@query("gap_table_scan", f"WITH {m.GAPS} SELECT 'c' || chr AS chr, start, stop, type FROM gaps WHERE type IN ('t1', 't2', 't3', 't13') AND start % 5 <> 0")
def _(t):
    """A gap table with its header; empty gaps and other types are left out."""
    g = t.gaps
    rows = g.select(
        F.lit(585).alias("bin"), F.concat(F.lit("c"), F.col("chr").cast("string")).alias("chr"), "start", "stop", F.lit(1).alias("ix"), F.lit("N").alias("n"),
        F.when(F.col("start") % 5 == 0, 0).otherwise(F.col("stop") - F.col("start")).alias("size"), "type", F.lit("no").alias("bridge"),
    )
    path = scratch(t, "gaps")
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return rd.read_gaps(t.spark, path, "t1 t2 t13").filter("type <> 't'").select("chr", "start", "stop", "type").union(rd.read_gaps(t.spark, path, "t3").select("chr", "start", "stop", "type"))


@query("gencode_scan", f"WITH {m.GENES}, e AS (SELECT name, chr, unnest(exons) AS x, unnest([1, 2]) AS n FROM genes) SELECT 'c' || chr AS chr, 'exon' AS feature, x.a AS start, x.b AS stop, 'id' || name AS gene_id, name AS gene_name, CAST(n AS INTEGER) AS exon_number FROM e")
def _(t):
    """Gene annotation with attributes."""
    e = t.genes.select("name", "chr", F.posexplode("exons").alias("k", "x"))
    attributes = F.concat(F.lit('gene_id "id'), "name", F.lit('"; transcript_id "tr"; gene_type "coding"; gene_name "'), "name", F.lit('"; exon_number '), (F.col("k") + 1).cast("string"), F.lit(";"))
    rows = e.select(F.concat(F.lit("c"), F.col("chr").cast("string")).alias("chr"), F.lit("src").alias("source"), F.lit("exon").alias("feature"), (F.col("x.start") + 1).alias("start"), F.col("x.stop").alias("stop"),
                    F.lit(".").alias("score"), F.lit("+").alias("strand"), F.lit(".").alias("frame"), attributes.alias("attributes"))
    g = rd.read_gtf(t.spark, text_file(t, wr.delimited(rows), "gtf"))
    return g.select("chr", "feature", "start", "stop", "gene_id", "gene_name", "exon_number")


@query("repeats_scan", f"WITH {m.REPEATS} SELECT 'c' || chr AS chr, start, stop, motif, CAST(length(motif) AS INTEGER) AS motif_length FROM repeats WHERE stop > start")
def _(t):
    """Tandem repeats in columns of white space."""
    r = t.repeats.filter("stop > start").select(F.concat(F.lit("c"), F.col("chr").cast("string")).alias("chr"), F.col("start").alias("pos"), (F.col("stop") - F.col("start")).alias("total_length"), F.length("motif").alias("motif_length"),
                                               F.lit(0).alias("start_base"), F.lit(2.5).alias("n_copies"), F.lit(1).alias("stop_base"), "motif")
    return rd.read_repeats(t.spark, text_file(t, wr.delimited(r, sep="   "), "repeats")).select("chr", "start", "stop", "motif", "motif_length")


_CN_BINS = "b AS (SELECT 'c' || (p_partkey % 3) AS chr, p_partkey * 100 AS start, p_size + 50 AS length, (p_partkey % 10) / 10.0 AS gc, CAST(p_partkey % 200 AS DOUBLE) AS map, p_retailprice AS corr FROM part)"


def cn_bins(t):
    k = F.col("p_partkey")
    rows = t.part.select(F.concat(F.lit("c"), (k % 3).cast("string")).alias("chr"), (k * 100).alias("start"), (F.col("p_size") + 50).alias("length"), ((k % 10) / 10).alias("gc"), (k % 200).cast("double").alias("map"), F.col("p_retailprice").alias("corr"), F.lit(0).alias("bad"))
    return rd.read_cn_bins(t.spark, text_file(t, wr.delimited(rows), "cn-bins"))


@query("cn_bins_scan", f"WITH {_CN_BINS} SELECT chr, start, start + length AS stop, round(gc, 6) AS gc, map FROM b")
def _(t):
    """Bins with their GC and mappability."""
    return cn_bins(t).select("chr", "start", "stop", rounded("gc").alias("gc"), "map")


@query("cn_bins_normalised", f"WITH {_CN_BINS}, u AS (SELECT list_sort(list(corr))[count(*) // 2 + 1] AS mc, list_sort(list(length))[count(*) // 2 + 1] AS ml FROM b) SELECT chr, start, round(corr / mc, 6) AS corr FROM b, u WHERE NOT (map > 150 OR gc < 0.3 OR length < ml / 2.0)")
def _(t):
    """Corrections over their median, unusual bins cut."""
    return rd.normalised_bins(cn_bins(t), cut=True).select("chr", "start", rounded("corr").alias("corr"))


@query("cn_results_scan", f"WITH {m.PROFILE} SELECT CAST(sample AS INTEGER) AS sample, CAST(bin AS INTEGER) AS bin, CAST(count AS INTEGER) AS count, round(ratio, 6) AS ratio FROM profile")
def _(t):
    """Results with a header, by name."""
    path = scratch(t, "cn-results")
    t.profile.select("sample", "bin", "count", "ratio").write.option("header", True).option("sep", "\t").csv(path)
    return rd.read_cn_results(t.spark, path).select("sample", "bin", "count", rounded("ratio").alias("ratio"))


@query("cn_segments_scan", f"WITH {m.PROFILE} SELECT sample, CAST(min(bin) AS INTEGER) AS start, CAST(max(bin) AS INTEGER) AS stop, round(avg(ratio), 6) AS call_score, round(max(ratio), 6) AS prob_event FROM profile GROUP BY 1")
def _(t):
    """Segments, with the score of the pass rule and the event probability by name."""
    path = scratch(t, "cn-segments")
    s = t.profile.groupBy("sample").agg(F.min("bin").alias("start"), F.max("bin").alias("stop"), F.avg("ratio").alias("call_score"), F.max("ratio").alias("prob_event"))
    s.write.option("header", True).option("sep", "\t").csv(path)
    return rd.read_cn_segments(t.spark, path).select("sample", "start", "stop", rounded("call_score").alias("call_score"), rounded("prob_event").alias("prob_event"))


@query("finebins_scan", f"WITH {m.MUMS} SELECT chr, pos, count(*) AS count FROM mums GROUP BY 1, 2")
def _(t):
    """Dense counts per base as raw integers, written and read in blocks."""
    path = scratch(t, "finebins")
    wr.write_finebins(cn.fine_counts(t.placed), t.chromosomes, path)
    return rd.read_finebins(t.spark, path, 500)


@query("mappability_text", f"WITH {_MAPPA} SELECT concat_ws(' ', chr, pos, low, high) AS value FROM mappa")
def _(t):
    """K7: a mappability dump."""
    return wr.delimited(mappa(t), ["chr", "pos", "low", "high"], " ")


@query("split_fasta", f"WITH {_SEQS} SELECT 'b' || (CAST(substr(name, 2) AS BIGINT) % 7) AS file, count(*) AS records, CAST(sum(length(seq)) AS BIGINT) AS bases FROM s GROUP BY 1")
def _(t):
    """A file per record name, read back; texts with the same number modulo 7 share a name."""
    path = scratch(t, "split-fasta")
    s = seqs(t).withColumn("name", F.concat(F.lit("b"), (F.substring("name", 2, 20).cast("long") % 7).cast("string")))
    wr.split_fasta(s, path)
    return rd.read_fasta(t.spark, f"{path}/name=*").groupBy(F.col("name").alias("file")).agg(F.count("*").alias("records"), F.sum(F.length("seq")).alias("bases"))


_SEX_COUNTS = f"""{m.PAIRS}, {m.SAMPLES}, k AS (SELECT chr, pos, CASE chr WHEN 0 THEN 'auto' WHEN 1 THEN 'X' ELSE 'Y' END AS region, sex, count(*) AS count FROM mums JOIN pairs USING (pair_id) JOIN samples USING (sample) GROUP BY ALL)"""


@query("empirical_counts", f"""WITH {_SEX_COUNTS}, a AS (SELECT chr, pos, region, coalesce(sum(count) FILTER (sex = 'XY'), 0) AS male, coalesce(sum(count) FILTER (sex = 'XX'), 0) AS female FROM k GROUP BY ALL),
c AS (SELECT *, CASE region WHEN 'X' THEN female WHEN 'Y' THEN male ELSE male + female END AS n FROM a), l AS (SELECT 1.1 * list_sort(list(n))[count(*) // 2 + 1] AS lim FROM c WHERE region = 'auto' AND n > 0),
f AS (SELECT sum(male) AS m, sum(female) AS f FROM c, l WHERE region = 'auto' AND n <= lim), t AS (SELECT chr, pos, n, lim, n * CASE region WHEN 'X' THEN CAST(m + f AS DOUBLE) / f WHEN 'Y' THEN 2.0 * (m + f) / m ELSE 1.0 END AS total FROM c, l, f)
SELECT chr, pos, CAST(CASE WHEN total > lim THEN 0 ELSE n END AS BIGINT) AS count, round(total, 6) AS total, total > lim AS bad FROM t""")
def _(t):
    """Population counts per base, sexes apart on X and Y, and bases above the cut."""
    region = F.when(F.col("chr") == 0, "auto").when(F.col("chr") == 1, "X").otherwise("Y")
    mums = t.placed.join(t.orders.select(F.col("o_orderkey").alias("pair_id"), (F.col("o_custkey") % 20).cast("int").alias("sample")), "pair_id").join(t.samples.select("sample", "sex"), "sample")
    counts = mums.groupBy("chr", "pos", region.alias("region"), "sex").agg(F.count("*").alias("count"))
    return cn.empirical_counts(counts, 1.1).select("chr", "pos", "count", rounded("total").alias("total"), "bad")


@query("theoretical_counts", f"WITH {_MAPPA}, s(sex) AS (VALUES ('XX'), ('XY')) SELECT sex, chr, pos, CAST(n AS INTEGER) AS count FROM (SELECT sex, chr, pos, CASE WHEN sex = 'XX' THEN CASE WHEN chr = 2 THEN 0 ELSE 2 END ELSE CASE WHEN chr = 0 THEN 2 ELSE 1 END END AS n FROM mappa, s WHERE low BETWEEN 15 AND 40) WHERE n > 0")
def _(t):
    """Copies of every mappable base by sex."""
    return cn.theoretical_counts(mappa(t), {1: "X", 2: "Y"})


@query("url_and_html_text", """SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, replace(replace(replace(replace(substr(html, 1, length(html)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""")
def _(t):
    """Section 2.8: parts of URLs, text as HTML."""
    return t.pages.select("page_id", tx.url_host(F.col("url")).alias("host"), tx.html_escape(F.col("html")).alias("escaped"))


@query("form_fields", "SELECT p_partkey, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part")
def _(t):
    """Section 2.8: fields of a form, encoded and decoded."""
    body = F.concat(F.lit("name="), tx.url_encode(F.col("p_name")), F.lit("&size="), F.col("p_size").cast("string"), F.lit("&empty"))
    f = t.part.select("p_partkey", tx.form_fields(body).alias("f"))
    return f.select("p_partkey", F.try_element_at("f", F.lit("name")).alias("name"), F.try_element_at("f", F.lit("size")).alias("size"))


@query("packed_integers", "SELECT p_partkey, CAST(p_partkey % 8 AS BIGINT) AS a, CAST(p_size % 64 AS BIGINT) AS b, CAST(p_partkey % 1024 AS BIGINT) AS c FROM part")
def _(t):
    """Section 2.8: small integers packed into one long and back."""
    widths = {"a": 3, "b": 6, "c": 10}
    packed = t.part.select("p_partkey", tx.packed([F.col("p_partkey") % 8, F.col("p_size") % 64, F.col("p_partkey") % 1024], list(widths.values())).alias("x"))
    return packed.select("p_partkey", *[c.alias(k) for c, k in zip(tx.unpacked(F.col("x"), list(widths.values())), widths, strict=True)])
