"""Coordinates: regions, absolute positions, positions of matches in reads, and bridge geometry.

Positions are zero-based in tables and one-based in region strings.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_offsets(chromosomes: DataFrame) -> DataFrame:
    """(chr, len) with the running ``offset`` of each chromosome; a dimension of a few rows."""
    w = Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)
    return chromosomes.withColumn("offset", F.coalesce(F.sum("len").over(w), F.lit(0)).cast("long"))


def add_abspos(df: DataFrame, chromosomes: DataFrame, chr_col: str = "chr", pos_col: str = "pos") -> DataFrame:
    dim = with_offsets(chromosomes).select(F.col("chr").alias("__chr"), "offset")
    return df.join(dim, F.col(chr_col) == F.col("__chr"), "left").withColumn("abspos", F.col("offset") + F.col(pos_col)).drop("__chr", "offset")


def to_chrpos(df: DataFrame, chromosomes: DataFrame, abspos: str = "abspos") -> DataFrame:
    """Inverse of :func:`add_abspos`: a range join with the chromosome dimension, as one expression over its rows."""
    dim = with_offsets(chromosomes)
    packed = dim.agg(F.array_sort(F.collect_list(F.struct("offset", "chr", "len"))).alias("__dim"))
    hit = F.filter("__dim", lambda c: (c["offset"] <= F.col(abspos)) & (F.col(abspos) < c["offset"] + c["len"]))
    # the dimension is one row of as many structs as there are chromosomes
    return df.crossJoin(F.broadcast(packed)).withColumn("__hit", F.get(hit, F.lit(0))).withColumn("chr", F.col("__hit")["chr"]).withColumn("pos", F.col(abspos) - F.col("__hit")["offset"]).drop("__dim", "__hit")


def parse_region(text: str) -> tuple[str, int, int | None]:
    """``chr:start-stop`` (one-based, inclusive) to (chr, zero-based start, exclusive stop)."""
    m = re.fullmatch(r"([^:]+)(?::([\d,]+)(?:-([\d,]+))?)?", text.strip())
    if not m:
        raise ValueError(f"not a region: {text!r}")
    start = int(m[2].replace(",", "")) - 1 if m[2] else 0
    stop = int(m[3].replace(",", "")) if m[3] else start + 1 if m[2] else None
    if start < 0 or stop is not None and stop <= start:
        raise ValueError(f"empty region: {text!r}")
    return m[1], start, stop


def in_region(region: str, chr_col: str = "chr", pos_col: str = "pos") -> Column:
    name, start, stop = parse_region(region)
    chr_, pos = F.col(chr_col), F.col(pos_col)
    found = (chr_.cast("string") == name) & (pos >= start)
    return found if stop is None else found & (pos < stop)


def read_position(pos: Column, off: Column, length: Column, flipped: Column, read_len: Column) -> Column:
    """Where the read would start if the match extended over it without gaps."""
    return F.when(flipped, pos - read_len + off + length).otherwise(pos - off)


def anchor_position(pos: Column, length: Column, high: Column) -> Column:
    return F.when(high, pos + length - 1).otherwise(pos)


def invariant(high1: Column, pos1: Column, high2: Column, pos2: Column, offset: Column) -> Column:
    sign = lambda h: F.when(h, 1).otherwise(-1)
    return sign(high1) * pos1 + sign(high2) * pos2 + offset


def orientation(high1: Column, high2: Column) -> Column:
    """'=' for opposite sides, 'i' for two high anchors, 'o' for two low ones."""
    return F.when(high1 != high2, "=").when(high1, "i").otherwise("o")


#: Size classes of events, as (largest size, name).
SIZE_CLASSES = ((1, "single"), (10, "1s"), (100, "10s"), (10**3, "100s"), (10**4, "1Ks"), (10**5, "10Ks"), (10**6, "100Ks"), (10**7, "1Ms"), (10**8, "10Ms"))


def describe(chr1: Column, pos1: Column, high1: Column, chr2: Column, pos2: Column, high2: Column, offset: Column) -> Column:
    """Class of an event: translocation, or a size class and what happened."""
    inv = invariant(high1, pos1, high2, pos2, offset)
    plain = high1 != high2
    size = F.when((inv == 0) | ~plain, F.abs(pos1 - pos2)).otherwise(F.abs(inv))
    ladder = F.lit("100Ms")
    for most, name in reversed(SIZE_CLASSES):
        ladder = F.when(size <= most, name).otherwise(ladder)
    kind = F.when(~plain & high1, "inversion").when(~plain, "outversion").when(inv == 0, "substitution").when(inv > 0, "insertion").otherwise("deletion")
    ladder = F.when(plain & (inv == 0) & (size <= 2), "single").otherwise(ladder)
    return F.when(chr1 != chr2, "translocation").otherwise(F.concat_ws(" ", ladder, kind))
