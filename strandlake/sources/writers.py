"""Writers and format conversions: each gives a DataFrame of lines or writes partitioned files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement
from .readers import SAM_FIELDS, has_flag


def save_store(df: DataFrame, path: str, *partitions: str) -> None:
    """Parquet, partitioned and sorted by chromosome and position where they exist, so that ranges prune row groups."""
    keys = [c for c in ("chr", "chr1", "pos", "pos1") if c in df.columns]
    out = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    out.write.partitionBy(*partitions).parquet(path)


def fasta_lines(df: DataFrame, width: int = 60) -> DataFrame:
    """FASTA text of (name, seq), wrapped."""
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return df.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), wrapped).alias("value"))


def split_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    """One folder of files per record name."""
    record = F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n"))
    df.select("name", record.alias("value")).write.partitionBy("name").text(path)


def sam_lines(sam: DataFrame) -> DataFrame:
    """SAM text of a parsed table, tags in order of name (typed i for whole numbers, Z otherwise)."""
    fixed = [F.coalesce(F.col(n).cast("string"), F.lit("*")) for n, _ in SAM_FIELDS]
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.when(e["value"].rlike("^-?[0-9]+$"), ":i:").otherwise(":Z:"), e["value"]))
    return sam.select(F.concat_ws("\t", *fixed, tags).alias("value"))


def sam_to_fastq(sam: DataFrame, length: int | None = None, read: int | None = None) -> DataFrame:
    """Primary, good reads as FASTQ records; reads on the reverse strand are turned back."""
    rows = sam.filter(~has_flag(F.col("flag"), "secondary") & ~has_flag(F.col("flag"), "supplementary") & ~has_flag(F.col("flag"), "bad_quality"))
    if read:
        rows = rows.filter(has_flag(F.col("flag"), "first" if read == 1 else "second"))
    back = has_flag(F.col("flag"), "reverse")
    seq, qual = F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq")), F.when(back, F.reverse("qual")).otherwise(F.col("qual"))
    cut = (lambda c: F.substring(c, 1, length)) if length else (lambda c: c)
    return rows.select("name", "flag", F.concat(F.lit("@"), F.col("name"), F.lit("\n"), cut(seq), F.lit("\n+\n"), cut(qual)).alias("value"))


def fastq_to_sam(pairs: DataFrame, replace_n: str | None = None) -> DataFrame:
    """Unaligned SAM rows of FASTQ pairs, first mate before second."""
    seq = lambda k: F.translate(F.col(f"seq{k}"), "N", replace_n) if replace_n else F.col(f"seq{k}")
    mate = lambda k, flag: F.struct(F.lit(flag).alias("flag"), seq(k).alias("seq"), F.col(f"qual{k}").alias("qual"))
    rows = pairs.select("pair_id", "name", F.explode(F.array(mate(1, 77), mate(2, 141))).alias("m"))
    return rows.select(
        "pair_id", "name", "m.flag", F.lit("*").alias("ref"), F.lit(0).cast("long").alias("pos"), F.lit(0).alias("mapq"), F.lit("*").alias("cigar"), F.lit("*").alias("mref"), F.lit(0).cast("long").alias("mpos"),
        F.lit(0).cast("long").alias("tlen"), "m.seq", "m.qual", F.create_map().cast("map<string,string>").alias("tags"),
    )


def name_pairs(sam: DataFrame) -> DataFrame:
    """First and second primary read of each name, in any input order: a shuffled equi-join on the name."""
    primary = sam.filter(~has_flag(F.col("flag"), "secondary") & ~has_flag(F.col("flag"), "supplementary"))
    side = lambda f, k: primary.filter(has_flag(F.col("flag"), f)).select("name", *[F.col(c).alias(f"{c}{k}") for c in ("flag", "ref", "pos", "seq", "qual")])
    return side("first", 1).join(side("second", 2).hint("shuffle_hash"), "name")


def mums_text(mums: DataFrame, one_based: bool = True) -> DataFrame:
    """One line per pair with its matches in order; pairs by their first match in genome order."""
    shift = 1 if one_based else 0
    cell = F.concat_ws(":", F.col("chr"), F.col("pos") + shift, "off", "len", F.when(F.col("flipped"), "-").otherwise("+"), F.when(F.col("read_2"), "2").otherwise("1"))
    lines = mums.groupBy("pair_id").agg(F.min(F.struct("chr", "pos", "read_2", "off", "len")).alias("first"), F.sort_array(F.collect_list(F.struct("ord", cell.alias("m")))).alias("ms"))
    return lines.orderBy("first", "pair_id").select("pair_id", F.array_join(F.transform("ms", lambda x: x["m"]), " ").alias("line"))


def mums_to_sam(mums: DataFrame, reads: DataFrame) -> DataFrame:
    """SAM rows of matches: clipped around the match, the longest one primary; ``reads`` (pair_id, read_2, seq, qual)."""
    best = F.row_number().over(Window.partitionBy("pair_id", "read_2").orderBy(F.desc("len"), "ord"))
    m = mums.join(reads, ["pair_id", "read_2"]).withColumn("rank", best)
    tail = F.col("read_len") - F.col("off") - F.col("len")
    left, right = F.when(F.col("flipped"), tail).otherwise(F.col("off")), F.when(F.col("flipped"), F.col("off")).otherwise(tail)
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    flag = F.lit(1) + F.when(F.col("flipped"), 16).otherwise(0) + F.when(F.col("read_2"), 128).otherwise(64) + F.when(F.col("rank") > 1, 256).otherwise(0)
    turned = lambda c, f: F.when(F.col("flipped"), f(F.col(c))).otherwise(F.col(c))
    return m.select(
        F.col("pair_id").cast("string").alias("name"), flag.alias("flag"), F.col("chr").cast("string").alias("ref"), (F.col("pos") + 1).alias("pos"), F.lit(255).alias("mapq"),
        F.concat(clip(left), F.col("len").cast("string"), F.lit("M"), clip(right)).alias("cigar"), F.lit("*").alias("mref"), F.lit(0).cast("long").alias("mpos"), F.lit(0).cast("long").alias("tlen"),
        turned("seq", reverse_complement).alias("seq"), turned("qual", F.reverse).alias("qual"), F.create_map().cast("map<string,string>").alias("tags"),
    )


def delimited(df: DataFrame, columns: list[str] | None = None, sep: str = "\t", missing: str = "-") -> DataFrame:
    """Lines of text; null is written as the missing mark, booleans as 0 and 1."""
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        x = F.col(c).cast("int") if kinds[c] == "boolean" else F.col(c)
        return F.coalesce(x.cast("string"), F.lit(missing))

    return df.select(F.concat_ws(sep, *[cell(c) for c in columns or df.columns]).alias("value"))


def write_by_column(df: DataFrame, column: str, path: str) -> None:
    """One folder per value of a column, whatever order the rows are in."""
    df.repartition(column).write.partitionBy(column).option("header", True).csv(path)


def write_finebins(counts: DataFrame, lengths: DataFrame, path: str) -> None:
    """Dense counts per base, one file of unsigned integers per chromosome; ``lengths``: chr, len.

    A chromosome's counts are sorted apart and written as a stream, in pieces of
    bounded size. Each file is written under another name and then moved.
    """
    rows = counts.select("chr", "pos", "count").join(lengths.select("chr", "len"), "chr").unionByName(lengths.select("chr", (F.col("len") - 1).cast("long").alias("pos"), F.lit(0).cast("long").alias("count"), "len"))
    rows = rows.groupBy("chr", "pos", "len").agg(F.sum("count").alias("count")).filter("pos >= 0 AND pos < len").repartition("chr").sortWithinPartitions("chr", "pos")

    def run(batches):
        import uuid

        import numpy as np
        import pandas as pd
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        store.create_dir(root, recursive=True)
        chromosome, sink, at, mark = None, None, 0, uuid.uuid4().hex
        done = []

        def close():
            if sink is not None:
                sink.close()
                store.move(f"{root}/_{mark}.{chromosome}", f"{root}/{chromosome}.bin")
                done.append(chromosome)

        for b in batches:
            for c, part in b.groupby("chr", sort=False):
                if c != chromosome:
                    close()
                    chromosome, at = c, 0
                    sink = store.open_output_stream(f"{root}/_{mark}.{c}")
                pos, n = part["pos"].to_numpy(), part["count"].to_numpy()
                while len(pos):  # the bases up to the next counts, a piece at a time
                    end = min(int(pos[-1]) + 1, at + (1 << 20))
                    k = int(np.searchsorted(pos, end))
                    piece = np.zeros(end - at, "<u4")
                    piece[pos[:k] - at] = n[:k]
                    sink.write(piece.tobytes())
                    pos, n, at = pos[k:], n[k:], end
        close()
        yield pd.DataFrame({"chr": pd.array(done, "Int32")})

    rows.mapInPandas(run, "chr int").write.format("noop").mode("overwrite").save()


def junction_bed(junctions: DataFrame, window: int = 5) -> DataFrame:
    """BED of windows around exon junctions; closer ones merge."""
    from ..operators.intervals import merge_intervals

    ends = junctions.select("chr", F.explode(F.array("stop", "start")).alias("p"))
    return merge_intervals(ends.select("chr", (F.col("p") - window).alias("start"), (F.col("p") + window).alias("stop"))).select("chr", "start", "stop")


def viewer_tables(profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log ratios per bin, and runs of equal segment ratio, for genome viewers."""
    from ..operators.intervals import run_lengths

    ratios = profile.select("sample", "chr", "bin", F.log2("ratio").alias("log_ratio"))
    runs = run_lengths(profile, ["sample", "chr"], "bin", "seg_ratio").select("sample", "chr", "first", "last", "n", F.log2("seg_ratio").alias("log_ratio"))
    return ratios, runs
