"""Operators on sequences: k-mers, exact matches between texts, uniqueness, consensus, repeats, reads."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import bases, hamming, kmers, reverse_complement
from ..shared import stored


def kmer_counts(df: DataFrame, seq: str, k: int, both_strands: bool = True) -> DataFrame:
    """Occurrences of every k-mer; with both strands each one counts for its reverse complement too.

    The forward counts are summed first, so the doubling happens on distinct
    k-mers and not on all occurrences.
    """
    forward = df.select(F.explode(kmers(F.col(seq), k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
    if not both_strands:
        return forward
    return forward.union(forward.select(reverse_complement(F.col("kmer")), "n")).groupBy("kmer").agg(F.sum("n").alias("n"))


def consensus(df: DataFrame, keys: list[str], seq: str, alphabet: str = "ACGT") -> DataFrame:
    """Majority base per position, 'x' where there is none or a tie."""
    cells = df.select(*keys, F.posexplode(bases(F.col(seq))).alias("pos", "base"))
    counts = cells.groupBy(*keys, "pos").agg(*[F.count_if(F.col("base") == b).alias(f"n_{b}") for b in alphabet])
    most = F.greatest(*[F.col(f"n_{b}") for b in alphabet])
    winners = F.filter(F.array(*[F.when(F.col(f"n_{b}") == most, F.lit(b)) for b in alphabet]), lambda x: x.isNotNull())
    call = F.when((most > 0) & (F.size(winners) == 1), winners[0]).otherwise("x")
    # positions of a consensus are as many as the longest read has
    return counts.select(*keys, F.struct("pos", call.alias("base")).alias("c")).groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["base"]), "").alias("consensus"))


def base_counts(df: DataFrame, keys: list[str], seq: str, alphabet: str = "ACGTN") -> DataFrame:
    """Bases per cycle."""
    cells = df.select(*keys, F.posexplode(bases(F.col(seq))).alias("cycle", "base"))
    return cells.groupBy(*keys, "cycle").agg(F.count("*").alias("depth"), *[F.count_if(F.col("base") == b).alias(b) for b in alphabet])


def quality_stats(df: DataFrame, qual: str, offset: int = 33) -> DataFrame:
    """Mean and smallest base quality per cycle."""
    cells = df.select(F.posexplode(bases(F.col(qual))).alias("cycle", "q"))
    return cells.groupBy("cycle").agg(F.count("*").alias("n"), F.avg(F.ascii("q") - offset).alias("mean_quality"), F.min(F.ascii("q") - offset).alias("min_quality"))


def match_barcodes(reads: DataFrame, barcodes: DataFrame, most: int, column: str = "barcode") -> DataFrame:
    """The one barcode nearest to each read's, if within ``most`` mismatches; ties are unknown.

    The barcode sheet of a run is one row of an array, so each read is compared
    in place; equal read barcodes are compared once.
    """
    sheet = barcodes.agg(F.collect_list(F.struct("barcode", "name")).alias("sheet"))
    seen = reads.select(F.col(column).alias("seen")).distinct().crossJoin(F.broadcast(sheet))  # one row
    scored = seen.select("seen", F.transform("sheet", lambda b: F.struct(hamming(F.col("seen"), b["barcode"]).alias("d"), b["name"].alias("name"))).alias("s"))
    least = F.array_min(F.transform("s", lambda x: x["d"]))
    best = scored.withColumn("distance", least).withColumn("hits", F.filter("s", lambda x: x["d"] == F.col("distance")))
    named = best.select("seen", "distance", F.when((F.size("hits") == 1) & (F.col("distance") <= most), F.col("hits")[0]["name"]).otherwise("unknown").alias("name"))
    return reads.join(named, F.col(column) == F.col("seen"), "left").drop("seen")


def placed_kmers(df: DataFrame, name: str, k: int, chunk: int = 256) -> DataFrame:
    """(name, at, kmer) of every substring of length k of ``seq``.

    A sequence is cut into overlapping chunks first: a substring of a long text
    costs its distance from the start, so that all k-mers of a whole text would
    cost its length squared.
    """
    n = F.length("seq")
    cut = df.filter(n >= k).select(name, F.explode(F.sequence(F.lit(0), n - k, F.lit(chunk))).alias("begin"), "seq")
    cut = cut.select(name, "begin", F.explode(F.array(F.substring("seq", F.col("begin") + 1, F.lit(chunk + k - 1)))).alias("piece"))
    return cut.select(name, "begin", F.posexplode(kmers(F.col("piece"), k)).alias("i", "kmer")).select(name, (F.col("begin") + F.col("i")).alias("at"), "kmer")


def maximal_matches(queries: DataFrame, reference: DataFrame, least: int) -> DataFrame:
    """All maximal exact matches of at least ``least`` characters: (query, ref, q_start, r_start, len).

    ``queries`` (query, seq) and ``reference`` (ref, seq). Seeds are an equi-join
    of the k-mers; consecutive seeds on one diagonal are one match, which is
    maximal by construction.
    """
    q, r = placed_kmers(queries, "query", least).withColumnRenamed("at", "q_pos"), placed_kmers(reference, "ref", least).withColumnRenamed("at", "r_pos")
    hits = q.join(r, "kmer").select("query", "ref", (F.col("r_pos") - F.col("q_pos")).alias("diagonal"), "q_pos")
    w = Window.partitionBy("query", "ref", "diagonal").orderBy("q_pos")
    island = F.col("q_pos") - F.row_number().over(w)
    return hits.withColumn("island", island).groupBy("query", "ref", "diagonal", "island").agg(F.min("q_pos").alias("q_start"), (F.max("q_pos") - F.min("q_pos") + least).alias("len")).select(
        "query", "ref", "q_start", (F.col("q_start") + F.col("diagonal")).alias("r_start"), "len"
    )


def unique_matches(queries: DataFrame, reference: DataFrame, least: int, both_strands: bool = False) -> DataFrame:
    """Maximal matches whose string occurs once in the reference (once on either strand with ``both_strands``).

    A match occurs again exactly if another match of the same query covers its
    query interval. With both strands the reference is joined with its reverse
    complement under the same names, ``flipped`` tells which one was hit.
    """
    ref = reference.select("ref", "seq", F.lit(False).alias("flipped"))
    if both_strands:
        ref = ref.union(reference.select("ref", reverse_complement(F.col("seq")), F.lit(True)))
    packed = ref.select(F.struct("ref", "flipped").alias("ref"), "seq")
    m = maximal_matches(queries, packed, least)
    # intervals of a query in order of start: it is covered by another one if an earlier start reaches its end, or an equal interval exists
    w = Window.partitionBy("query").orderBy("q_start", F.desc("len"))
    reach = F.max(F.col("q_start") + F.col("len")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    same = F.count("*").over(Window.partitionBy("query", "q_start", "len"))
    kept = m.withColumn("reach", reach).withColumn("same", same).filter((F.col("same") == 1) & (F.col("reach").isNull() | (F.col("reach") < F.col("q_start") + F.col("len"))))
    return kept.select("query", F.col("ref.ref").alias("ref"), F.col("ref.flipped").alias("flipped"), "q_start", "r_start", "len")


def mappability(reference: DataFrame, most: int = 254, block: int = 8) -> DataFrame:
    """Shortest unique length to the right (low) and to the left (high) of every base: (ref, pos, low, high).

    255: not unique before the end of its chromosome; ``most`` (254): longer than
    can be told. Suffixes are sorted inside blocks of equal first characters, and
    each is compared with its neighbours there: the longest common prefix plus
    one. Blocks are separate groups of one window; two suffixes of different
    blocks share less than ``block`` characters, which is told by how many
    suffixes begin with each shorter prefix: tables of a few thousand rows.
    """
    out = []
    for name, seq in (("low", F.col("seq")), ("high", F.reverse("seq"))):
        s = reference.select("ref", seq.alias("seq"), F.length("seq").alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        s = s.select("ref", "n", "i", F.substring(F.col("seq"), F.col("i") + 1, F.lit(most + 1)).alias("suffix"))
        heads = stored(s.groupBy(F.substring("suffix", 1, block - 1).alias("head")).agg(F.count("*").alias("m")), "suffix-heads")
        w = Window.partitionBy(F.substring("suffix", 1, block)).orderBy("suffix", "ref", "i")
        near = s.withColumn("before", F.lag("suffix").over(w)).withColumn("after", F.lead("suffix").over(w))
        near = near.withColumn("shared", F.greatest(*[F.coalesce(_common_prefix(F.col("suffix"), F.col(x)), F.lit(0)) for x in ("before", "after")]))
        # what a suffix shares with other blocks: the longest prefix of it that others begin with
        long = [heads.select("m", F.substring("head", 1, k).alias("head")).filter(F.length("head") == k).groupBy("head").agg(F.sum("m").alias("m")).filter("m > 1").select("head", F.lit(k).alias("k")) for k in range(1, block)]
        shared = reduce(DataFrame.union, long)
        own = heads.select("head").withColumn("p", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("head"), F.lit(1))), lambda k: F.substring("head", F.lit(1), k))))
        others = own.join(shared.withColumnRenamed("head", "p"), "p").groupBy("head").agg(F.max("k").alias("others"))
        near = near.withColumn("head", F.substring("suffix", 1, block - 1)).join(others, "head", "left")
        least = F.greatest("shared", F.coalesce("others", F.lit(0))) + 1
        m = F.when(least > F.col("n") - F.col("i"), 255).when(least > most, most).otherwise(least)
        pos = F.col("i") if name == "low" else F.col("n") - 1 - F.col("i")
        out.append(near.select("ref", pos.alias("pos"), m.cast("int").alias(name)))
    return out[0].join(out[1], ["ref", "pos"])


def _common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix (up to 511), by bisection over substring equality."""

    def step(n: Column, by: Column) -> Column:
        longer = n + by
        fits = (F.length(a) >= longer) & (F.length(b) >= longer) & (F.substring(a, F.lit(1), longer) == F.substring(b, F.lit(1), longer))
        return F.when(fits, longer).otherwise(n)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(8, -1, -1)]), F.lit(0), step)


def mappability_small(reference: DataFrame, most: int = 254) -> DataFrame:
    """As the definition says, by sorted suffixes in one task: for references up to about a hundred kilobases."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for name, turn in (("low", False), ("high", True)):
            texts = {r: s[::-1] if turn else s for r, s in zip(pdf["ref"], pdf["seq"], strict=True)}
            suffixes = sorted((s[i : i + most + 1], r, i) for r, s in texts.items() for i in range(len(s)))
            common = [0] * (len(suffixes) + 1)
            for k in range(1, len(suffixes)):
                a, b = suffixes[k - 1][0], suffixes[k][0]
                n = 0
                while n < min(len(a), len(b)) and a[n] == b[n]:
                    n += 1
                common[k] = n
            for k, (_, r, i) in enumerate(suffixes):
                left = len(texts[r]) - i
                u = max(common[k], common[k + 1]) + 1
                rows.append((r, len(texts[r]) - 1 - i if turn else i, name, 255 if u > left else min(u, most)))
        out = pd.DataFrame(rows, columns=["ref", "pos", "side", "m"]).pivot(index=["ref", "pos"], columns="side", values="m").reset_index()
        return out[["ref", "pos", "low", "high"]].astype({"pos": "int64", "low": "int32", "high": "int32"})

    ref_type = reference.schema["ref"].dataType.simpleString()
    return reference.select("ref", "seq", F.lit(0).alias("all")).groupBy("all").applyInPandas(lambda p: run(p), f"ref {ref_type}, pos long, low int, high int")


def tandem_repeats(sequences: DataFrame, longest_motif: int = 6, least_copies: int = 3) -> DataFrame:
    """Maximal runs of a repeated motif: (ref, start, total_length, motif); motif minimal and its smallest rotation."""

    def runs(seq: str) -> Iterator[tuple[int, int, str]]:
        a, taken = np.frombuffer(seq.encode("latin-1", "replace"), np.uint8), []
        for m in range(1, longest_motif + 1):
            if len(a) < m * least_copies:
                break
            same = np.r_[False, a[m:] == a[:-m], False]
            edges = np.flatnonzero(same[1:] != same[:-1])
            for s, e in zip(edges[::2], edges[1::2], strict=True):
                start, stop = int(s), int(e) + m
                # a run of a shorter motif is that motif's
                if stop - start >= m * least_copies and not any(x <= start and stop <= y for x, y in taken):
                    taken.append((start, stop))
                    motif = seq[start : start + m]
                    yield start, stop - start, min(motif[i:] + motif[:i] for i in range(m))

    ref_type = sequences.schema["ref"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(r, *x) for r, s in zip(b["ref"], b["seq"], strict=True) for x in runs(s or "")], columns=["ref", "start", "total_length", "motif"])

    return sequences.select("ref", "seq").mapInPandas(run, f"ref {ref_type}, start long, total_length long, motif string")


def repeated_substrings(df: DataFrame, seq: str, length: int) -> DataFrame:
    """Substrings of a length that occur more than once, with their number."""
    return df.select(F.explode(kmers(F.col(seq), length)).alias("substring")).groupBy("substring").agg(F.count("*").alias("n")).filter("n > 1")


def parse_read(seq: Column, fixed: list[tuple[str, int]], pattern: str, least: int = 4) -> Column:
    """Pieces of a read: fixed-size parts first, then the key up to the start of a pattern's longest prefix.

    Returns a struct with the fixed parts and ``rest``: ``key`` (what lies before
    the pattern) and ``matched`` (pattern characters found, one mismatch allowed);
    key is null if no more than ``least`` characters match.
    """
    parts, at = [], 1
    for name, size in fixed:
        parts.append(F.substring(seq, at, size).alias(name))
        at += size
    def found(rest: Column) -> Column:
        """(key, matched) from the letters of the read's rest, as an array."""

        def prefix(i: Column) -> Column:
            """Characters of the pattern that match from position i on, up to the second mismatch."""
            cells = F.transform(F.array(*[F.lit(c) for c in pattern]), lambda c, k: F.coalesce((F.get(rest, i + k) != c).cast("int"), F.lit(2)))
            return F.aggregate(cells, F.struct(F.lit(0).alias("bad"), F.lit(0).alias("n")), lambda a, c: F.struct((a["bad"] + c).alias("bad"), F.when(a["bad"] + c <= 1, a["n"] + 1).otherwise(a["n"]).alias("n")), lambda a: a["n"])

        best = F.array_max(F.transform(rest, lambda _, i: F.struct(prefix(i).alias("n"), (-i).alias("back"))))
        return F.get(F.transform(F.array(best), lambda x: F.struct(F.when(x["n"] > least, F.array_join(F.slice(rest, F.lit(1), -x["back"]), "")).alias("key"), F.coalesce(x["n"], F.lit(0)).alias("matched"))), 0)

    # the letters are bound once: inside a function they would be split again for every place
    letters = bases(F.substring(seq, F.lit(at), F.greatest(F.length(seq) - (at - 1), F.lit(0))))
    hit = F.get(F.transform(F.array(letters), found), 0)
    return F.struct(*parts, hit.alias("rest"))


def pileup(reads: DataFrame) -> DataFrame:
    """Bases over every position: (chr, pos, base, n), one vote per pair; ``reads``: pair_id, chr, pos, seq."""
    cells = reads.select("pair_id", "chr", F.col("pos").alias("p"), F.posexplode(bases(F.col("seq"))).alias("k", "base")).select("pair_id", "chr", (F.col("p") + F.col("k")).alias("pos"), "base")
    votes = cells.groupBy("chr", "pos", "pair_id").agg(F.min("base").alias("base"), F.max("base").alias("other")).filter("base = other")
    return votes.groupBy("chr", "pos", "base").agg(F.count("*").alias("n"))


def genotype(piled: DataFrame, least: int = 2, share: float = 0.2) -> DataFrame:
    """Called bases per position: those with at least ``least`` votes and ``share`` of all."""
    total = F.sum("n").over(Window.partitionBy("chr", "pos"))
    kept = piled.withColumn("total", total).filter((F.col("n") >= least) & (F.col("n") >= share * F.col("total")))
    return kept.groupBy("chr", "pos", "total").agg(F.array_join(F.sort_array(F.collect_list("base")), "/").alias("call"))
