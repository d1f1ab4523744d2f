"""Readers of genomics text formats and of generic tables. All give DataFrames; nothing is collected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The eleven mandatory SAM fields and their types.
SAM_FIELDS = (("name", "string"), ("flag", "int"), ("ref", "string"), ("pos", "long"), ("mapq", "int"), ("cigar", "string"), ("mref", "string"), ("mpos", "long"), ("tlen", "long"), ("seq", "string"), ("qual", "string"))
#: SAM flag bits.
SAM_FLAGS = ("paired", "proper", "unmapped", "mate_unmapped", "reverse", "mate_reverse", "first", "second", "secondary", "bad_quality", "duplicate", "supplementary")


def _records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): the first word of each header, bases in upper case. A record is a row, read in parallel."""
    head = F.element_at(F.split("value", "\n"), 1)
    rest = F.regexp_replace(F.substring(F.col("value"), F.length(head) + 1, F.length("value")), r"\s+", "")
    return _records(spark, path, ">").filter("trim(value) <> ''").select(F.element_at(F.split(F.trim(head), r"\s+"), 1).alias("name"), F.upper(rest).alias("seq"))


def reference_blocks(fasta: DataFrame, size: int = 1 << 16) -> DataFrame:
    """Sequences cut into blocks, the unit in which a genome is stored and joined: (name, block, start, seq)."""
    cut = fasta.select("name", "seq", F.posexplode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(size))).alias("block", "start"))
    return cut.select("name", "block", "start", F.substring(F.col("seq"), F.col("start") + 1, F.lit(size)).alias("seq"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their numbers from 0, in files of any size, compressed or not.

    Files are read in splits. The rows of a split are numbered in reading order;
    what lies before a split is the prefix sum of the counts of a file's splits,
    one small row each.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value")
    splits = rows.groupBy("file", "split").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(splits, ["file", "split"]).select("file", (F.col("id") - F.col("first") + F.col("before")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, name, seq, qual) of four-line records, in files of any size, plain or gzip; a cut-off last record is left out."""
    lines = numbered_lines(spark, path).select("file", F.expr("line div 4").alias("record"), (F.col("line") % 4).alias("k"), F.rtrim("value").alias("value"))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    rows = lines.groupBy("file", "record").agg(F.count("*").alias("n"), at(0).alias("head"), at(1).alias("seq"), at(3).alias("qual")).filter("n = 4")
    return rows.select("file", "record", F.substring_index(F.substring("head", 2, 1 << 30), " ", 1).alias("name"), "seq", "qual")


def fastq_pairs(one: DataFrame, two: DataFrame | None = None) -> DataFrame:
    """(pair_id, name, seq1, seq2, qual1, qual2): two files, or one with mates after each other."""
    if two is None:
        first, second = one.filter("record % 2 = 0"), one.filter("record % 2 = 1")
        one, two = first.withColumn("record", F.expr("record div 2")), second.withColumn("record", F.expr("record div 2"))
    b = two.select("record", F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    return one.select("record", "name", F.col("seq").alias("seq1"), F.col("qual").alias("qual1")).join(b, "record").select(F.col("record").alias("pair_id"), "name", "seq1", "seq2", "qual1", "qual2")


def sam_flags(flag: Column) -> Column:
    """Names of the bits that are set."""
    return F.filter(F.array(*[F.when(flag.bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(SAM_FLAGS)]), lambda x: x.isNotNull())


def has_flag(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(1 << SAM_FLAGS.index(name)) != 0


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The mandatory fields, and optional ones as a map of tag to value."""
    parts = F.split("value", "\t")
    fields = [F.get(parts, F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(SAM_FIELDS)]
    pairs = F.transform(F.slice(parts, 12, F.greatest(F.size(parts), F.lit(1))), lambda x: F.struct(F.substring(x, 1, 2), F.substring(x, F.lit(6), F.length(x))))
    return spark.read.text(path).filter("value <> '' AND NOT startswith(value, '@')").select(*fields, F.map_from_entries(pairs).alias("tags"))


def cigar_parts(cigar: Column) -> Column:
    """(n, op) of a CIGAR string."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), 1), lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("n"), F.substring(x, F.length(x), F.lit(1)).alias("op")))


def cigar_ref_length(cigar: Column) -> Column:
    """Reference bases that an alignment spans."""
    return F.aggregate(cigar_parts(cigar), F.lit(0), lambda n, p: n + F.when(p["op"].isin("M", "D", "N", "=", "X"), p["n"]).otherwise(0))


def unclipped_start(pos: Column, cigar: Column) -> Column:
    """Position at which the read would start had its beginning not been clipped."""
    first = F.get(cigar_parts(cigar), F.lit(0))
    return pos - F.coalesce(F.when(first["op"].isin("S", "H"), first["n"]), F.lit(0))


def _tabbed(spark: SparkSession, path: str, schema: str, header: bool = False, comment: str | None = "#", sep: str = "\t") -> DataFrame:
    reader = spark.read.schema(schema).option("sep", sep).option("header", header)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, stop); an interval with start >= stop is an error when it is read."""
    bed = _tabbed(spark, path, "chr string, start long, stop long")
    ok = F.when(F.col("start") < F.col("stop"), F.col("start")).otherwise(F.raise_error(F.concat(F.lit("bad interval "), F.concat_ws(" ", "chr", "start", "stop"))).cast("long"))
    return bed.withColumn("start", ok)


def read_known_genes(spark: SparkSession, path: str, isoforms: str | None = None) -> DataFrame:
    """UCSC known genes with exons as an array of (start, stop); names or chromosomes with '_' are left out."""
    g = _tabbed(spark, path, "name string, chr string, strand string, t_start long, t_stop long, c_start long, c_stop long, n_exons int, starts string, stops string")
    ends = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    g = g.filter("NOT contains(substring(name, 1, 30), '_') AND NOT contains(substring(chr, 1, 30), '_')")
    g = g.withColumn("exons", F.transform(F.arrays_zip(ends("starts").alias("start"), ends("stops").alias("stop")), lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop")))).drop("starts", "stops")
    if isoforms:
        g = g.join(_tabbed(spark, isoforms, "cluster int, name string"), "name", "left")
    return g


def exon_junctions(genes: DataFrame) -> DataFrame:
    """(name, chr, stop, start, intron_length) between consecutive exons."""
    pairs = F.transform(F.slice("exons", 2, F.greatest(F.size("exons"), F.lit(1))), lambda e, i: F.struct(F.get("exons", i)["stop"].alias("stop"), e["start"].alias("start")))
    return genes.select("name", "chr", F.explode(pairs).alias("j")).select("name", "chr", "j.stop", "j.start", (F.col("j.start") - F.col("j.stop")).alias("intron_length"))


def read_gene_xref(spark: SparkSession, path: str) -> DataFrame:
    return _tabbed(spark, path, "name string, mRNA string, spID string, spDisplayID string, geneSymbol string, refSeq string, protAcc string, description string", comment=None)


def read_gaps(spark: SparkSession, path: str, types: str = "") -> DataFrame:
    """Gap table; sizes above 0 and types that the list names (all if empty)."""
    g = _tabbed(spark, path, "bin int, chr string, start long, stop long, ix int, n string, size long, type string, bridge string", header=True, comment=None).filter("size > 0")
    return g.filter(F.instr(F.lit(types), F.col("type")) > 0) if types else g


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """GENCODE annotation, one-based starts made zero-based, with its common attributes as columns."""
    g = _tabbed(spark, path, "chr string, source string, feature string, start long, stop long, score string, strand string, frame string, attributes string")
    attr = lambda k: F.regexp_extract("attributes", rf'(?:^|; ?){k} "([^"]*)"', 1).alias(k)
    return g.select("chr", "source", "feature", (F.col("start") - 1).alias("start"), "stop", "strand", attr("gene_id"), attr("transcript_id"), attr("gene_name"), attr("gene_type"), F.regexp_extract("attributes", r"exon_number (\d+)", 1).cast("int").alias("exon_number"))


def read_repeats(spark: SparkSession, path: str) -> DataFrame:
    r = spark.read.text(path).filter("value <> ''").select(F.split(F.trim("value"), r"\s+").alias("c"))
    names = (("chr", "string"), ("pos", "long"), ("total_length", "long"), ("motif_length", "int"), ("start_base", "long"), ("n_copies", "double"), ("stop_base", "long"), ("motif", "string"))
    return r.select(*[F.get("c", F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(names)]).withColumns({"start": F.col("pos"), "stop": F.col("pos") + F.col("total_length")})


def read_families(spark: SparkSession, path: str) -> DataFrame:
    """One line per family: name, then (member sample sex) triples. Comments are skipped; a blank line ends the file.

    A family file is a cohort's list, so its line numbers come from one window.
    """
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    w = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    blank = F.sum(F.when(F.trim("text") == "", 1).otherwise(0)).over(w)
    words = lines.withColumn("blank", blank).filter("blank = 0 AND NOT startswith(text, '#')").select("line", F.split(F.trim("text"), r"\s+").alias("w"))
    n = F.expr("(size(w) - 1) div 3")
    each = words.filter("size(w) > 3").select("line", F.col("w")[0].alias("family"), "w", F.posexplode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("k", "j"))
    at = lambda i: F.get("w", 3 * F.col("k") + i)
    relation = F.when(at(1).isin("mother", "father"), "parent").when(at(1).isin("proband", "sibling"), "child").otherwise(at(1))
    count = lambda c: F.length(at(3)) - F.length(F.replace(at(3), F.lit(c), F.lit("")))
    return each.select("family", at(1).alias("member"), at(2).alias("sample"), at(3).alias("sex"), relation.alias("relation"), count("X").alias("n_x"), count("Y").alias("n_y"))


def read_cn_bins(spark: SparkSession, path: str) -> DataFrame:
    return _tabbed(spark, path, "chr string, start long, length long, gc double, map double, corr double, bad int", comment=None).withColumn("stop", F.col("start") + F.col("length"))


def normalised_bins(bins: DataFrame, max_map: float = 150, min_gc: float = 0.3, cut: bool = False) -> DataFrame:
    """corr over its upper median; with ``cut`` only mappable bins of usual length and GC."""
    from ..functions.stats import upper_median

    m = upper_median(bins, [], "corr", "m_corr").crossJoin(upper_median(bins, [], "length", "m_length"))  # single rows
    out = bins.crossJoin(F.broadcast(m)).withColumn("corr", F.col("corr") / F.col("m_corr"))
    if cut:
        out = out.filter(~((F.col("map") > max_map) | (F.col("gc") < min_gc) | (F.col("length") < F.col("m_length") / 2)))
    return out.drop("m_corr", "m_length")


def read_cn_results(spark: SparkSession, path: str) -> DataFrame:
    """Results with a header, minimal or full."""
    return spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(path)


def read_cn_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments by name; the score of the pass rule is ``call_score``, the twelfth column is ``prob_event``."""
    return read_cn_results(spark, path)


def read_pop_bridges(spark: SparkSession, path: str, with_chr1: bool = True) -> DataFrame:
    names = (["chr1"] if with_chr1 else []) + ["pos1", "high1", "chr2", "pos2", "high2", "offset", "n_people", "n_bridges", "median_bridges", "max_bridges"]
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c"))
    kind = lambda n: "string" if n.startswith("chr") else "long"
    cells = [F.get("c", F.lit(i)).cast(kind(n)).alias(n) for i, n in enumerate(names)]
    return rows.select(*cells).withColumns({c: F.col(c) != 0 for c in ("high1", "high2")})


def read_bridges(spark: SparkSession, path: str, chr1: int | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Bridge tables in Parquet; the range reaches the scan as a pushed filter."""
    b = spark.read.parquet(path)
    for cond, on in ((F.col("chr1") == chr1, chr1), (F.col("pos1") >= start, start), (F.col("pos1") < stop, stop)):
        b = b.filter(cond) if on is not None else b
    return b


def infer_delimiter(header: str) -> str:
    """The only kind of separator that occurs; else tab before comma before space; else tab."""
    kinds = [c for c in "\t, " if c in header]
    return kinds[0] if kinds else "\t"


def read_table(spark: SparkSession, path: str, delimiter: str = "auto", infer: str = "tsv") -> DataFrame:
    """A text table with a header. ``infer``: tsv (integers, then reals, then text), summary (reals or text) or none.

    Types are decided from all cells by one aggregation.
    """
    if delimiter == "auto":
        first = spark.read.text(path).first()
        delimiter = infer_delimiter(first[0] if first else "")
    rows = spark.read.option("sep", delimiter).option("header", True).option("quote", "").csv(path)
    lowered = [c.lower() for c in rows.columns]
    if len(set(lowered)) < len(lowered):
        raise ValueError("duplicate column names")
    if infer == "none":
        return rows
    whole = lambda c: F.every(F.coalesce(F.col(f"`{c}`").rlike("^-?[0-9]+$"), F.lit(False)))
    real = lambda c: F.every(F.expr(f"try_cast(`{c}` AS double)").isNotNull())
    kinds = rows.agg(*[F.struct(whole(c).alias("i"), real(c).alias("r")).alias(f"c{k}") for k, c in enumerate(rows.columns)]).first()
    types = ["bigint" if kinds[k]["i"] and infer == "tsv" else "double" if kinds[k]["r"] else "string" for k in range(len(rows.columns))]
    return rows.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in zip(rows.columns, types, strict=True)])


def read_integers(spark: SparkSession, path: str, dtype: str = "<u4", block: int = 1 << 20, pattern: str = "*") -> DataFrame:
    """(file, index, value) of raw integer dumps; a file is read in blocks of ``block`` numbers, each a task's unit."""
    import numpy as np

    width = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", (F.col("length") / width).cast("long").alias("size"))
    blocks = files.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            for p, size, at in b.itertuples(index=False):
                store, name = fs.FileSystem.from_uri(p) if "://" in p or p.startswith("file:") else (fs.LocalFileSystem(), p)
                with store.open_input_file(name) as f:
                    a = np.frombuffer(f.read_at(min(block, size - at) * width, at * width), dtype)
                yield pd.DataFrame({"file": p, "index": np.arange(at, at + len(a)), "value": a.astype(np.int64)})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(n, "path", "at").mapInPandas(run, "file string, index long, value long")


def read_finebins(spark: SparkSession, path: str, block: int = 1 << 20) -> DataFrame:
    """(chr, pos, count) of dense counts per base, one file ``<chr>.bin`` per chromosome; bases without counts are left out."""
    rows = read_integers(spark, path, "<u4", block, "*.bin").filter("value > 0")
    return rows.select(F.regexp_extract("file", r"([^/]+)\.bin$", 1).cast("int").alias("chr"), F.col("index").alias("pos"), F.col("value").alias("count"))


def read_jdbc(spark: SparkSession, url: str, table: str, partition: str | None = None, bounds: tuple[int, int] | None = None, n: int = 16) -> DataFrame:
    """A table of an external database; with a partition column it is read in parallel ranges."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition and bounds:
        r = r.option("partitionColumn", partition).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", n)
    return r.load()


def optional_fields(sam: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Chosen tags of a SAM table as columns (tag to name)."""
    if any(not re.fullmatch(r"[A-Za-z][A-Za-z0-9]", t) for t in formats):
        raise ValueError("tags have two characters")
    return sam.select("*", *[F.try_element_at("tags", F.lit(t)).alias(n) for t, n in formats.items()])
