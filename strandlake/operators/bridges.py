"""Matches in reads, the bridges between them, and bridges across a population.

Tables (see :mod:`strandlake.plans.model` for how the driver tables map to them):

* ``mums``: sample, pair_id, ord (order in the pair), chr, pos, off, len,
  flipped, read_2, read_len, last_hit, touches_end
* ``pairs``: pair_id, len1, len2, bad1, bad2, dupe
* bridges: chr1, pos1, high1, chr2, pos2, high2, offset and support lengths

Duplicates and bridges come from the match store (:mod:`strandlake.operators.store`),
one row per pair. What is asked of single matches in a flat table is a window over
(pair, read), whose groups are as small as a read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import anchor_position, invariant, read_position
from .store import MAX_MATE_DISTANCE, SIGNATURE, SUPPORT

#: Fixed value: the largest value of a saturating count.
SATURATED = 65535


def with_read_position(mums: DataFrame) -> DataFrame:
    return mums.withColumn("readpos", read_position(F.col("pos"), F.col("off"), F.col("len"), F.col("flipped"), F.col("read_len")))


def first_mums(mums: DataFrame) -> DataFrame:
    """First match of each read in stored order."""
    return mums.groupBy("pair_id", "read_2").agg(F.min_by(F.struct("ord", "chr", "pos", "off", "len", "flipped", "read_len"), "ord").alias("m")).select("pair_id", "read_2", "m.*")


def read_support(mums: DataFrame) -> DataFrame:
    """``mums`` with low_support and high_support: own length plus co-linear matches of the read on either side."""
    m = with_read_position(mums)
    w = Window.partitionBy("pair_id", "read_2", "chr", "flipped", "readpos").orderBy("ord")
    before = F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.coalesce(F.sum("len").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return m.withColumns({
        "low_support": (F.col("len") + F.when(F.col("flipped"), after).otherwise(before)).cast("int"),
        "high_support": (F.col("len") + F.when(F.col("flipped"), before).otherwise(after)).cast("int"),
        "seen_low": F.min("pos").over(whole), "seen_high": F.max(F.col("pos") + F.col("len") - 1).over(whole),
    })


def mate_support(mums: DataFrame) -> DataFrame:
    """``mums`` (with read support) and mate_support: new bases that the mate adds on the far side.

    An ordered fold over the mate's matches, from the last to the first, that
    keeps the range seen so far; the fold runs inside the JVM on the array of one
    read's matches.
    """
    mates = mums.groupBy("pair_id", (~F.col("read_2")).alias("read_2")).agg(
        F.sort_array(F.collect_list(F.struct("ord", "chr", "pos", "len", "flipped")), asc=False).alias("mates")
    )
    high = ~F.col("flipped")

    def step(acc: Column, x: Column) -> Column:
        end = x["pos"] + x["len"] - 1
        usable = (x["chr"] == F.col("chr")) & (x["flipped"] != F.col("flipped"))
        far_high = (end <= acc["hi"]) | (x["pos"] > F.col("pos") + MAX_MATE_DISTANCE)
        far_low = (x["pos"] >= acc["lo"]) | (F.col("pos") > x["pos"] + MAX_MATE_DISTANCE)
        gain_high = end - F.greatest(acc["hi"] + 1, x["pos"]) + 1
        gain_low = F.least(acc["lo"], end + 1) - x["pos"]
        take = usable & F.when(high, ~far_high).otherwise(~far_low)
        return F.struct(
            (acc["n"] + F.when(take, F.when(high, gain_high).otherwise(gain_low)).otherwise(0)).cast("long").alias("n"),
            F.when(take, F.least(acc["lo"], x["pos"])).otherwise(acc["lo"]).cast("long").alias("lo"),
            F.when(take, F.greatest(acc["hi"], end)).otherwise(acc["hi"]).cast("long").alias("hi"),
        )

    start = F.struct(F.lit(0).cast("long").alias("n"), F.col("seen_low").cast("long").alias("lo"), F.col("seen_high").cast("long").alias("hi"))
    folded = F.when(F.col("mates").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate("mates", start, step, lambda a: a["n"]))
    return mums.join(mates, ["pair_id", "read_2"], "left").withColumn("mate_support", folded).drop("mates")


def bridge_invariant() -> Column:
    return invariant(F.col("high1"), F.col("pos1"), F.col("high2"), F.col("pos2"), F.col("offset"))


def sample_bridges(observed: DataFrame) -> DataFrame:
    """Bridges of a sample from those of its pairs: counts (saturating) and largest supports."""
    count = lambda c: F.least(c, F.lit(SATURATED)).cast("int")
    return observed.groupBy("sample", *SIGNATURE).agg(
        count(F.count("*")).alias("bridge_count"), *[F.max(c).alias(c) for c in SUPPORT],
        count(F.count_if(F.col("mate1_len") > 0)).alias("mate1_count"), count(F.count_if(F.col("mate2_len") > 0)).alias("mate2_count"),
    )


def combine_bridges(parts: list[DataFrame]) -> DataFrame:
    """Union of bridge tables of the same samples: counts add up, supports are the largest."""
    from functools import reduce

    both = reduce(DataFrame.unionByName, parts)
    add = lambda c: F.least(F.sum(c), F.lit(SATURATED)).cast("int").alias(c)
    return both.groupBy("sample", *SIGNATURE).agg(*[add(c) for c in ("bridge_count", "mate1_count", "mate2_count")], *[F.max(c).alias(c) for c in SUPPORT])


def population_database(bridges: DataFrame, samples: DataFrame, relations: tuple[str, ...] = ("parent", "normal", "source", "matched", "before")) -> DataFrame:
    """Bridges seen among unrelated samples: people, bridges, upper median and largest count.

    A signature is seen at most once per sample, so its counts are as many as
    there are samples; bridges without effect and those with one read in every
    sample are left out.
    """
    own = bridges.join(samples.filter(F.col("relation").isin(*relations)).select("sample"), "sample")
    counts = F.sort_array(F.collect_list("bridge_count"))
    out = own.groupBy(*SIGNATURE).agg(
        F.count("*").alias("n_people"), F.sum("bridge_count").alias("n_bridges"), F.get(counts, F.floor(F.count("*") / 2).cast("int")).alias("median_bridges"), F.max("bridge_count").alias("max_bridges")
    )
    return out.filter((bridge_invariant() != 0) & (F.col("n_people") != F.col("n_bridges")))


def with_population(bridges: DataFrame, population: DataFrame) -> DataFrame:
    """Left join with the population table; unseen bridges get zeros."""
    seen = ["n_people", "n_bridges", "median_bridges", "max_bridges"]
    out = bridges.join(population.select(*SIGNATURE, *[F.col(c).alias(f"pop_{c}") for c in seen]), SIGNATURE, "left")
    return out.withColumns({f"pop_{c}": F.coalesce(F.col(f"pop_{c}"), F.lit(0)) for c in seen})


def with_mappability(bridges: DataFrame, mappability: DataFrame) -> DataFrame:
    """Low and high mappability of both anchors, and the excess of each anchor's support over that of its side."""
    for k in (1, 2):
        m = mappability.select(F.col("chr").alias(f"chr{k}"), F.col("pos").alias(f"pos{k}"), F.col("low").alias(f"low{k}"), F.col("high").alias(f"high_map{k}"))
        bridges = bridges.join(m, [f"chr{k}", f"pos{k}"], "left")
        side = F.when(F.col(f"high{k}"), F.col(f"high_map{k}")).otherwise(F.col(f"low{k}"))
        bridges = bridges.withColumn(f"excess{k}", F.col(f"anchor{k}_len") - side)
    return bridges


def anchors_at(mums: DataFrame, chr_: int, pos: int, high: bool) -> DataFrame:
    """Matches that end at a position on the given side, but not at an end of their read."""
    at_read_end = F.when(F.col("flipped") != F.lit(high), (F.col("off") + F.col("len")) >= F.col("read_len")).otherwise(F.col("off") == 0)
    return mums.filter((F.col("chr") == chr_) & (anchor_position(F.col("pos"), F.col("len"), F.lit(high)) == pos) & ~at_read_end)


def lookup_bridge(mums: DataFrame, a: tuple[int, int, bool], b: tuple[int, int, bool], wanted: int) -> DataFrame:
    """Pairs of matches of one read at two anchors whose bridge has the wanted invariant."""
    left = anchors_at(mums, *a).select("pair_id", "read_2", F.col("ord").alias("a_ord"), F.col("off").alias("a_off"), F.col("len").alias("a_len"))
    right = anchors_at(mums, *b).select("pair_id", "read_2", F.col("ord").alias("b_ord"), F.col("off").alias("b_off"), F.col("len").alias("b_len"))
    sign = {True: 1, False: -1}
    forward = F.col("a_ord") < F.col("b_ord")
    offset = F.when(forward, F.col("b_off") - (F.col("a_off") + F.col("a_len") - 1)).otherwise(F.col("a_off") - (F.col("b_off") + F.col("b_len") - 1))
    met = left.join(right, ["pair_id", "read_2"]).filter("a_ord <> b_ord").withColumn("offset", offset)
    return met.filter(F.lit(sign[a[2]] * a[1] + sign[b[2]] * b[1]) + F.col("offset") == wanted)


def select_cn_mums(mums: DataFrame, pairs: DataFrame, mappability: DataFrame | None = None, min_length: int = 20, min_excess: int = 20, max_mappability: int = 50) -> DataFrame:
    """One match per pair for copy number: the longest (first on ties) of pairs that are no duplicates."""
    best = mums.groupBy("pair_id").agg(F.max_by(F.struct("chr", "pos", "len", "read_2", "ord"), F.struct("len", -F.col("ord"))).alias("m")).select("pair_id", "m.*")
    kept = best.join(pairs.filter(~F.col("dupe")).select("pair_id"), "pair_id", "left_semi").filter(F.col("len") >= min_length)
    if mappability is None:
        return kept
    m = mappability.select("chr", "pos", F.least("low", "high").alias("map"))
    return kept.join(m, ["chr", "pos"]).filter((F.col("map") <= max_mappability) & (F.col("len") - F.col("map") >= min_excess))


def coverage_at(mums: DataFrame, positions: DataFrame, longest: int = 64) -> DataFrame:
    """Matches and pairs over each position; pairs count once even where both reads cover it."""
    from .intervals import point_join

    spans = mums.select("pair_id", "read_2", "chr", F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("stop"))
    hit = point_join(positions, spans, width=max(longest, 64))
    return hit.groupBy("chr", "pos").agg(F.count("*").alias("n_mums"), F.count_distinct("r_pair_id").alias("n_pairs"))


def anchor_counts(mums: DataFrame) -> DataFrame:
    """Per base: pairs whose match passes it, and pairs that anchor there, low and high."""
    spread = mums.select("pair_id", "chr", "len", F.col("pos").alias("s"), F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1)).alias("pos"))
    low, high = F.col("pos") == F.col("s"), F.col("pos") == F.col("s") + F.col("len") - 1
    return spread.groupBy("chr", "pos").agg(
        F.count_distinct(F.when(~low & ~high, F.col("pair_id"))).alias("reference"), F.count_distinct(F.when(low, F.col("pair_id"))).alias("low_anchor"),
        F.count_distinct(F.when(high, F.col("pair_id"))).alias("high_anchor"), F.max("len").alias("max_support"),
    )


def similar_bridges(bridges: DataFrame, wanted: DataFrame, slop: int, invariant_slop: int) -> DataFrame:
    """Bridges near a wanted one: same chromosomes and sides, first anchor and invariant within a tolerance.

    An equi-join on position bins of the tolerance's width: a wanted bridge looks
    into three bins.
    """
    width = max(1, 2 * slop + 1)
    b = bridges.withColumn("inv", bridge_invariant()).withColumn("bin", F.floor(F.col("pos1") / width))
    w = wanted.withColumn("inv", bridge_invariant()).select(*[F.col(c).alias(f"w_{c}") for c in SIGNATURE], F.col("inv").alias("w_inv"))
    at = F.floor(F.col("w_pos1") / width)
    w = w.withColumn("w_bin", F.explode(F.array(at - 1, at, at + 1)))
    cond = (
        (F.col("chr1") == F.col("w_chr1")) & (F.col("chr2") == F.col("w_chr2")) & (F.col("high1") == F.col("w_high1")) & (F.col("high2") == F.col("w_high2")) & (F.col("bin") == F.col("w_bin"))
        & (F.abs(F.col("pos1") - F.col("w_pos1")) <= slop) & (F.abs(F.col("inv") - F.col("w_inv")) <= invariant_slop)
    )
    return b.join(w, cond).drop("bin", "w_bin")


def simple_events(bridges: DataFrame, longest: int = 1_000_000) -> DataFrame:
    """Bridges that are insertions or deletions of bounded size on one chromosome."""
    inv = bridge_invariant()
    return bridges.filter((inv != 0) & (F.abs(inv) <= longest) & (F.col("chr1") == F.col("chr2")) & (F.col("high1") != F.col("high2")))


def pseudogene_bridges(bridges: DataFrame, junctions: DataFrame, slop: int = 20) -> DataFrame:
    """Bridges that join exons as a spliced copy would: (chr, stop, intron_length) of junctions within a tolerance."""
    inv = bridge_invariant()
    b = bridges.filter((F.col("chr1") == F.col("chr2")) & (F.col("high1") != F.col("high2")) & (inv < 0)).withColumn("inv", inv)
    width = 2 * slop + 1
    j = junctions.select(F.col("chr").alias("j_chr"), F.col("stop").alias("j_stop"), F.col("intron_length").alias("j_len"))
    j = j.withColumn("j_bin", F.explode(F.array(*[F.floor(F.col("j_stop") / width) + k for k in (-1, 0, 1)])))
    near = lambda p: F.abs(F.col(p) - F.col("j_stop")) <= slop
    hits = []
    for p in ("pos1", "pos2"):
        cond = (F.col("chr1") == F.col("j_chr")) & (F.floor(F.col(p) / width) == F.col("j_bin")) & near(p) & (F.abs(F.col("inv") + F.col("j_len")) <= slop)
        hits.append(b.join(j, cond, "left_semi"))
    return hits[0].union(hits[1]).distinct()


def unequal_bridges(bridges: DataFrame, pairs_per_sample: DataFrame, least: int = 5, p_value: float = 0.001) -> DataFrame:
    """Bridges whose counts differ between samples more than their numbers of pairs explain (Poisson).

    A signature meets the cohort's samples as one array in its own row; all tails
    of a batch of signatures are computed at once.
    """
    from ..functions.distributions import poisson_cdf

    cohort = pairs_per_sample.agg(F.sort_array(F.collect_list(F.struct("sample", "n_pairs"))).alias("cohort"), F.sum("n_pairs").alias("pairs"))
    totals = bridges.groupBy(*SIGNATURE).agg(F.sum("bridge_count").alias("total"), F.map_from_entries(F.collect_list(F.struct("sample", "bridge_count"))).alias("seen")).filter(F.col("total") >= least)
    rows = totals.crossJoin(F.broadcast(cohort))  # one row
    rows = rows.select(*SIGNATURE, "total", F.transform("cohort", lambda c: F.coalesce(F.element_at("seen", c["sample"]), F.lit(0)).cast("long")).alias("own"), F.transform("cohort", lambda c: F.col("total") * c["n_pairs"] / F.col("pairs")).alias("mean"))
    rows = rows.withColumns({"least": F.array_min("own"), "most": F.array_max("own")}).filter(10 * F.col("least") <= F.col("most"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            own, mean = np.stack(b.pop("own").to_numpy()).astype(float), np.stack(b.pop("mean").to_numpy()).astype(float)
            tail = np.minimum(1.0, 2 * np.minimum(poisson_cdf(own, mean), 1 - poisson_cdf(own - 1, mean)))
            yield b.assign(p=np.exp(np.log(np.maximum(tail, 1e-300)).sum(1)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("own", "mean").schema)
    return rows.mapInPandas(run, f"{kinds}, p double").filter(F.col("p") < p_value)


def incidental_split(bridges: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Per first anchor (and ``keys``): its most supported bridge is real, the others incidental."""
    w = Window.partitionBy(*keys, "chr1", "pos1", "high1").orderBy(F.desc("bridge_count"), "chr2", "pos2", "high2", "offset")
    return bridges.withColumn("real", F.row_number().over(w) == 1)
