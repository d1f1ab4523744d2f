"""Queries of readers and writers: tables are written in a format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import folder
from ..sources import readers as rd
from ..sources import writers as wr
from . import model as m
from .registry import query
from .sequence_queries import _DNA, as_dna


def scratch(t, name: str) -> str:
    """A new folder below the cluster's shared folder."""
    return folder(t.spark, name)


def text_file(t, df: DataFrame, name: str) -> str:
    path = scratch(t, name)
    df.write.text(path)
    return path


_SEQS = f"s AS (SELECT 'd' || doc_id AS name, {_DNA.format('text')} AS seq FROM documents)"


def seqs(t):
    return t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), as_dna("text").alias("seq"))


@query("fasta_round_trip", f"WITH {_SEQS} SELECT name, seq FROM s")
def _(t):
    """FASTA written with wrapped lines and read back."""
    return rd.read_fasta(t.spark, text_file(t, wr.fasta_lines(seqs(t)), "fasta"))


@query("reference_blocks", f"WITH {_SEQS} SELECT name, CAST(b AS INTEGER) AS block, CAST(b * 100 AS INTEGER) AS start, substr(seq, CAST(b * 100 + 1 AS BIGINT), 100) AS seq FROM (SELECT name, seq, unnest(range(greatest(1, (length(seq) + 99) // 100))) AS b FROM s)")
def _(t):
    """Sequences as blocks."""
    return rd.reference_blocks(seqs(t), 100)


_FASTQ = f"r AS (SELECT doc_id, {_DNA.format('text')} || 'ACGTN' AS seq FROM documents)"


def _fastq(t):
    """Reads and their records."""
    r = t.documents.select("doc_id", F.concat(as_dna("text"), F.lit("ACGTN")).alias("seq"))
    rec = F.concat(F.lit("@r"), F.col("doc_id").cast("string"), F.lit("/1\n"), F.col("seq"), F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq")))
    return r, rec


@query("fastq_scan", f"WITH {_FASTQ} SELECT 'r' || doc_id || '/1' AS name, seq, repeat('I', length(seq)) AS qual FROM r")
def _(t):
    """S3: FASTQ records."""
    r, rec = _fastq(t)
    return rd.read_fastq(t.spark, text_file(t, r.select(rec.alias("value")), "fastq")).select("name", "seq", "qual")


_SAM = f"""{_FASTQ}, sam AS (SELECT 'q' || (doc_id // 2) AS name, CASE WHEN doc_id % 2 = 0 THEN 65 ELSE 129 END + CASE WHEN doc_id % 3 = 0 THEN 16 ELSE 0 END AS flag, 'c' || (doc_id % 3) AS ref, doc_id * 3 + 1 AS pos, length(seq) || 'M' AS cigar, seq, repeat('I', length(seq)) AS qual, doc_id FROM r)"""


def _sam(t):
    r, _ = _fastq(t)
    d = F.col("doc_id")
    flag = (F.when(d % 2 == 0, 65).otherwise(129) + F.when(d % 3 == 0, 16).otherwise(0)).cast("int")
    none = F.lit(0).cast("long")
    return r.select(
        F.concat(F.lit("q"), F.floor(d / 2).cast("string")).alias("name"), flag.alias("flag"), F.concat(F.lit("c"), (d % 3).cast("string")).alias("ref"), (d * 3 + 1).alias("pos"), F.lit(60).alias("mapq"), F.concat(F.length("seq").cast("string"), F.lit("M")).alias("cigar"),
        F.lit("*").alias("mref"), none.alias("mpos"), none.alias("tlen"), "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"), F.create_map(F.lit("AS"), d.cast("string"), F.lit("SB"), F.lit("x")).alias("tags"),
    )


@query("sam_round_trip", f"WITH {_SAM} SELECT name, CAST(flag AS INTEGER) AS flag, ref, pos, cigar, seq, doc_id AS score, array_to_string(list_filter(['paired', CASE WHEN flag & 16 <> 0 THEN 'reverse' END, CASE WHEN flag & 64 <> 0 THEN 'first' END, CASE WHEN flag & 128 <> 0 THEN 'second' END], lambda x: x IS NOT NULL), ',') AS flags FROM sam")
def _(t):
    """SAM written and read, flags and tags."""
    s = rd.optional_fields(rd.read_sam(t.spark, text_file(t, wr.sam_lines(_sam(t)), "sam")), {"AS": "score"})
    return s.select("name", "flag", "ref", "pos", "cigar", "seq", F.col("score").cast("long").alias("score"), F.array_join(rd.sam_flags(F.col("flag")), ",").alias("flags"))


@query("sam_to_fastq", f"WITH {_SAM} SELECT name, '@' || name || chr(10) || CASE WHEN flag & 16 <> 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END || chr(10) || '+' || chr(10) || qual AS value FROM sam")
def _(t):
    """K8: reads back in their own direction."""
    return wr.sam_to_fastq(_sam(t)).select("name", "value")


@query("name_pairs", f"WITH {_SAM} SELECT a.name, a.pos AS pos1, b.pos AS pos2 FROM sam a JOIN sam b ON a.name = b.name AND a.flag & 64 <> 0 AND b.flag & 128 <> 0")
def _(t):
    """Mates met by name."""
    return wr.name_pairs(_sam(t)).select("name", "pos1", "pos2")


@query("fastq_to_sam", f"WITH {_FASTQ}, p AS (SELECT doc_id // 2 AS pair_id, max(seq) FILTER (doc_id % 2 = 0) AS a, max(seq) FILTER (doc_id % 2 = 1) AS b FROM r GROUP BY 1 HAVING count(*) = 2) SELECT CAST(pair_id AS BIGINT) AS pair_id, 77 AS flag, replace(a, 'N', 'A') AS seq FROM p UNION ALL SELECT pair_id, 141, replace(b, 'N', 'A') FROM p")
def _(t):
    """K9, S3: two FASTQ mates as unaligned SAM rows."""
    r, _rec = _fastq(t)
    one = r.select(F.col("doc_id").alias("record"), F.col("doc_id").cast("string").alias("name"), "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"))
    return wr.fastq_to_sam(rd.fastq_pairs(one), "A").select("pair_id", "flag", "seq")


@query("cigar_positions", "SELECT p_partkey, 100 - p_size AS start, CAST(20 + p_partkey % 9 + 3 AS INTEGER) AS span FROM part WHERE p_size > 0")
def _(t):
    """Section 2.8: reference span and unclipped start of an alignment."""
    c = F.concat(F.col("p_size").cast("string"), F.lit("S"), (F.col("p_partkey") % 9 + 20).cast("string"), F.lit("M2I3D"))
    return t.part.filter("p_size > 0").select("p_partkey", rd.unclipped_start(F.lit(100), c).alias("start"), rd.cigar_ref_length(c).alias("span"))


@query("bed_scan", f"WITH {m.GAPS} SELECT 'c' || chr AS chr, start, stop FROM gaps")
def _(t):
    """Intervals read from BED text."""
    g = t.gaps.select(F.concat(F.lit("c"), F.col("chr").cast("string")).alias("chr"), "start", "stop")
    return rd.read_bed(t.spark, text_file(t, wr.delimited(g), "bed"))


@query("known_genes_scan", f"WITH {m.GENES} SELECT name, 'c' || chr AS chr, start AS t_start, stop AS t_stop, exons[1].a AS first_start, exons[2].b AS last_stop FROM genes")
def _(t):
    """Gene tables with comma-terminated exon lists."""
    ends = lambda k: F.concat(F.array_join(F.transform("exons", lambda e: e[k].cast("string")), ","), F.lit(","))
    g = t.genes.select("name", F.concat(F.lit("c"), F.col("chr").cast("string")).alias("chr"), F.lit("+").alias("strand"), "start", "stop", F.col("start").alias("c1"), F.col("stop").alias("c2"), F.lit(2).alias("n"), ends("start").alias("starts"), ends("stop").alias("stops"))
    k = rd.read_known_genes(t.spark, text_file(t, wr.delimited(g), "genes"))
    return k.select("name", "chr", "t_start", "t_stop", F.col("exons")[0]["start"].alias("first_start"), F.col("exons")[1]["stop"].alias("last_stop"))


@query("exon_junctions", f"WITH {m.GENES} SELECT name, chr, exons[1].b AS stop, exons[2].a AS start, exons[2].a - exons[1].b AS intron_length FROM genes")
def _(t):
    """Junctions between exons."""
    return rd.exon_junctions(t.genes)


@query("junction_bed", f"WITH {m.GENES}, p AS (SELECT chr, unnest([exons[1].b, exons[2].a]) AS p FROM genes), w AS (SELECT chr, p - 5 AS start, p + 5 AS stop FROM p), r AS (SELECT *, max(stop) OVER (PARTITION BY chr ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w), "
       "i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS k FROM r) SELECT chr, min(start) AS start, max(stop) AS stop FROM i GROUP BY chr, k")
def _(t):
    """Merged windows around junctions."""
    return wr.junction_bed(rd.exon_junctions(t.genes))


@query("family_file", f"WITH {m.SAMPLES} SELECT 'f' || family AS family, member, 's' || sample AS sample, sex, CAST(length(replace(sex, 'Y', '')) AS INTEGER) AS n_x FROM samples")
def _(t):
    """A family file of member, sample and sex triples."""
    who = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sample", "member", "sex"))), lambda x: F.concat_ws(" ", x["member"], F.concat(F.lit("s"), x["sample"].cast("string")), x["sex"])), " ")
    lines = t.samples.groupBy("family").agg(F.concat_ws(" ", F.concat(F.lit("f"), F.col("family").cast("string")), who).alias("value")).select("value")
    f = rd.read_families(t.spark, text_file(t, lines.coalesce(1), "families"))
    return f.select("family", "member", "sample", "sex", "n_x")


@query("tsv_inference", "SELECT p_partkey AS key, p_name AS name, p_retailprice AS price FROM part")
def _(t):
    """A table of text whose delimiter and types are inferred."""
    path = scratch(t, "tsv")
    t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price")).write.option("header", True).option("sep", "\t").csv(path)
    return rd.read_table(t.spark, path)


@query("gzip_text", "SELECT r_name AS value FROM region")
def _(t):
    """Compressed text."""
    path = scratch(t, "gz")
    t.region.select(F.col("r_name").alias("value")).write.option("compression", "gzip").text(path)
    return t.spark.read.text(path)


@query("bridge_range_scan", f"WITH {m.BRIDGES} SELECT sample, {m.SIG}, bridge_count FROM bridges WHERE chr1 = 1 AND pos1 >= 200 AND pos1 < 700")
def _(t):
    """Bridges stored sorted, and a range read with pushed filters."""
    path = scratch(t, "bridges")
    wr.save_store(t.sample_bridges, path, "sample")
    return rd.read_bridges(t.spark, path, 1, 200, 700).select("sample", "chr1", "pos1", "high1", "chr2", "pos2", "high2", "offset", "bridge_count")


@query("pop_round_trip", f"WITH {m.POPULATION} SELECT CAST(chr1 AS VARCHAR) AS chr1, pos1, high1, n_people, n_bridges, CAST(max_bridges AS BIGINT) AS max_bridges FROM population")
def _(t):
    """The population table as text and back."""
    from ..operators.bridges import population_database

    p = population_database(t.sample_bridges, t.samples)
    names = ["chr1", "pos1", "high1", "chr2", "pos2", "high2", "offset", "n_people", "n_bridges", "median_bridges", "max_bridges"]
    return rd.read_pop_bridges(t.spark, text_file(t, wr.delimited(p, names), "pop")).select("chr1", "pos1", "high1", "n_people", "n_bridges", "max_bridges")


@query("bridges_text", f"WITH {m.BRIDGES} SELECT concat_ws(' ', chr1, pos1, CAST(high1 AS INTEGER), chr2, pos2, CAST(high2 AS INTEGER), \"offset\", bridge_count) AS value FROM bridges WHERE chr1 <= 1")
def _(t):
    """K5: bridges as text, for a range of chromosomes."""
    return wr.delimited(t.sample_bridges.filter("chr1 <= 1"), ["chr1", "pos1", "high1", "chr2", "pos2", "high2", "offset", "bridge_count"], " ")


@query("mums_text", f"WITH {m.MUMS} SELECT pair_id, string_agg(concat_ws(':', chr, pos + 1, off, len, CASE WHEN flipped THEN '-' ELSE '+' END, CASE WHEN read_2 THEN '2' ELSE '1' END), ' ' ORDER BY ord) AS line FROM mums GROUP BY 1")
def _(t):
    """One line of matches per pair."""
    return wr.mums_text(t.mums)


@query("mums_to_sam", f"WITH {m.MUMS}, k AS (SELECT *, row_number() OVER (PARTITION BY pair_id, read_2 ORDER BY len DESC, ord) AS rank, read_len - off - len AS tail FROM mums), c AS (SELECT *, CASE WHEN flipped THEN tail ELSE off END AS l, CASE WHEN flipped THEN off ELSE tail END AS r FROM k) "
       "SELECT CAST(pair_id AS VARCHAR) AS name, 1 + CASE WHEN flipped THEN 16 ELSE 0 END + CASE WHEN read_2 THEN 128 ELSE 64 END + CASE WHEN rank > 1 THEN 256 ELSE 0 END AS flag, pos + 1 AS pos, CASE WHEN l > 0 THEN l || 'S' ELSE '' END || len || 'M' || CASE WHEN r > 0 THEN r || 'S' ELSE '' END AS cigar FROM c")
def _(t):
    """K4: matches as SAM alignments."""
    reads = t.mums.select("pair_id", "read_2", F.repeat(F.lit("A"), F.col("read_len")).alias("seq"), F.repeat(F.lit("I"), F.col("read_len")).alias("qual")).distinct()
    return wr.mums_to_sam(t.mums, reads).select("name", "flag", "pos", "cigar")


@query("viewer_export", f"WITH {m.PROFILE} SELECT sample, chr, bin, round(log2(ratio), 6) AS log_ratio FROM profile")
def _(t):
    """Log ratios for viewers."""
    return wr.viewer_tables(t.profile)[0].withColumn("log_ratio", F.round("log_ratio", 6))


@query("column_split", "SELECT r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    """One folder per value, read back."""
    path = scratch(t, "split")
    wr.write_by_column(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_nationkey"), "r_name", path)
    return t.spark.read.option("header", True).schema("n_nationkey int, r_name string").csv(path).select("r_name", "n_nationkey")
