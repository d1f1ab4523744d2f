"""Copy number: fine counts, bins, normalisation, state calls, population tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_tail_1, poisson_lower, poisson_upper
from ..functions.stats import mad, mad_in_row, upper_median
from ..shared import stored
from .intervals import depth, genes_in_intervals, overlap_join, peaks, point_join, run_lengths
from .models import lowess
from .simulate import uniform

#: Copy states told apart, smallest ratio, and the score above which an event passes.
STATES, LEAST_RATIO, PASS_SCORE = 20, 0.01, 7.0


def fine_counts(mums: DataFrame) -> DataFrame:
    """Selected matches per base."""
    return mums.groupBy("chr", "pos").agg(F.count("*").alias("count"))


def add_fine_counts(parts: list[DataFrame]) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, parts).groupBy("chr", "pos").agg(F.sum("count").alias("count"))


def bin_counts(points: DataFrame, bins: DataFrame, weight: str | None = None) -> DataFrame:
    """Points per bin (0 for empty ones); bins: bin, chr, start, stop."""
    w = F.col(weight) if weight else F.lit(1)
    found = point_join(points, bins).groupBy(F.col("r_bin").alias("bin")).agg(F.sum(w).cast("long").alias("count"))
    return bins.join(found, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def allocate(totals: dict[int, float], n_bins: int, correction: dict[int, float] | None = None) -> dict[int, int]:
    """Bins per chromosome so that the least corrected count per bin is as high as swaps can make it.

    It starts in proportion to the corrected totals. Then a bin moves from the
    chromosome of the least count per bin to the one that has the most left
    after it got one more, as long as that is more; no allocation is tried twice.
    """
    size = {c: float(t) * (correction or {}).get(c, 1.0) for c, t in totals.items()}
    whole = sum(size.values())
    if not whole:
        return dict.fromkeys(size, 1)
    got = {c: max(1, int(n_bins * t / whole)) for c, t in size.items()}
    while sum(got.values()) < n_bins:
        got[max(size, key=lambda c: (size[c] / got[c], -c))] += 1
    tried = set()
    while len(size) > 1:
        low = min(size, key=lambda c: (size[c] / got[c], c))
        high = max(size, key=lambda c: (size[c] / (got[c] + 1), -c))
        if low == high or got[low] == 1 or size[low] / got[low] >= size[high] / (got[high] + 1):
            return got
        got[low] -= 1
        got[high] += 1
        if (state := tuple(sorted(got.items()))) in tried:
            return got
        tried.add(state)
    return got


def empirical_counts(counts: DataFrame, cut: float = 20.0) -> DataFrame:
    """Population counts per base for binning: (chr, pos, region, count, total, bad).

    ``counts``: chr, pos, region (auto, X or Y), sex (XX or XY) and count. X is
    counted in females and Y in males only, scaled by what these have of the
    autosomes. Bases whose scaled total is above ``cut`` upper medians of the
    autosomes' nonzero totals are bad, and count nothing.
    """
    male, female = F.col("sex") == "XY", F.col("sex") == "XX"
    amount = lambda which: F.coalesce(F.sum(F.when(which, F.col("count"))), F.lit(0))
    at = stored(counts.groupBy("chr", "pos", "region").agg(amount(male).alias("male"), amount(female).alias("female")), "base-totals")
    used = F.when(F.col("region") == "X", F.col("female")).when(F.col("region") == "Y", F.col("male")).otherwise(F.col("male") + F.col("female"))
    at = at.withColumn("count", used)
    usual = upper_median(at.filter("region = 'auto' AND count > 0"), [], "count", "usual").first()  # one row
    limit = cut * (usual["usual"] or 0) if usual else 0.0
    kept = at.filter((F.col("region") == "auto") & (F.col("count") <= limit)).agg(F.sum("male"), F.sum("female")).first()
    m, f = kept[0] or 0, kept[1] or 0
    # two copies of X in females, one of Y in males
    factor = F.when(F.col("region") == "X", F.lit((m + f) / f if f else 1.0)).when(F.col("region") == "Y", F.lit(2.0 * (m + f) / m if m else 1.0)).otherwise(1.0)
    total = factor * F.col("count")
    return at.select("chr", "pos", "region", F.when(total > limit, 0).otherwise(F.col("count")).cast("long").alias("count"), total.alias("total"), (total > limit).alias("bad"))


def theoretical_counts(mappability: DataFrame, regions: dict[int, str], least: int = 15, most: int = 40) -> DataFrame:
    """(sex, chr, pos, count): the copies that a sample of each sex has of every base whose low mappability is from ``least`` to ``most``."""
    region = F.coalesce(F.create_map(*[F.lit(x) for kv in regions.items() for x in kv])[F.col("chr")], F.lit("auto")) if regions else F.lit("auto")
    copies = F.when(F.col("sex") == "XX", F.when(region == "Y", 0).otherwise(2)).otherwise(F.when(region == "auto", 2).otherwise(1))
    rows = mappability.filter(F.col("low").between(least, most)).select("chr", "pos", F.explode(F.array(F.lit("XX"), F.lit("XY"))).alias("sex"))
    return rows.select("sex", "chr", "pos", copies.alias("count")).filter("count > 0")


def equal_mass_bins(counts: DataFrame, n_bins: int) -> DataFrame:
    """Bins of about equal total count, none across chromosomes: bin, chr, start, stop, count.

    Chromosome totals (a few dozen rows) are allocated on the driver. Inside a
    chromosome a bin closes at the base at which the running count reaches its
    next multiple of the target; the running count is a two-level prefix sum over
    blocks of bases, so a chromosome is not one task.
    """
    totals = {r[0]: float(r[1]) for r in counts.groupBy("chr").agg(F.sum("count")).collect()}
    got = allocate(totals, n_bins)
    dim = counts.sparkSession.createDataFrame([(c, totals[c] / n, n) for c, n in sorted(got.items())], "d_chr int, target double, n int")
    blocked = counts.withColumn("block", F.floor(F.col("pos") / 100_000))
    sums = blocked.groupBy("chr", "block").agg(F.sum("count").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("chr").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("count").over(Window.partitionBy("chr", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = blocked.join(sums.withColumn("before", before).select("chr", "block", "before"), ["chr", "block"]).withColumn("cum", F.col("before") + inside)
    at = F.least(F.floor(F.col("cum") / F.col("target") + 1e-9), F.col("n") - 1)
    binned = run.join(F.broadcast(dim), F.col("chr") == F.col("d_chr")).withColumn("k", at)
    rows = binned.groupBy("chr", "k").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"), F.sum("count").alias("count"))
    return rows.withColumn("bin", F.row_number().over(Window.orderBy("chr", "start")) - 1).select("bin", "chr", "start", "stop", "count")


def normalise(profile: DataFrame, corr: str = "corr") -> DataFrame:
    """ratio = count / corr, over its mean, not below the least ratio."""
    raw = F.col("count") / F.col(corr)
    mean = F.avg(raw).over(Window.partitionBy("sample"))
    return profile.withColumn("ratio", F.greatest(F.lit(LEAST_RATIO), raw / mean))


def gc_corrected(profile: DataFrame, frac: float = 0.1, iterations: int = 5, delta: float = 0.01) -> DataFrame:
    """Ratios over their smooth by GC content, per sample; columns sample, bin, gc, norm."""
    s = lowess(profile, ["sample"], "bin", "gc", "norm", frac, iterations, delta)
    return s.withColumn("ratio", F.greatest(F.lit(LEAST_RATIO), F.col("norm") / F.col("smooth")))


def bad_bins(profile: DataFrame, cut: float = 6.0) -> DataFrame:
    """Bins whose ratios spread over the samples more than ``cut`` deviations above what is usual in their region."""
    # a bin has one ratio per sample: a cohort's worth, told in one row
    both = profile.filter("ratio IS NOT NULL").groupBy("bin", "region").agg(mad_in_row(F.collect_list("ratio")).alias("x"))
    spread = stored(both.select("bin", "region", F.col("x.mad").alias("spread")), "bin-spreads")
    usual = mad(spread, ["region"], "spread").select("region", F.col("median").alias("usual"), F.col("mad").alias("dev"))
    return spread.join(F.broadcast(usual), "region").withColumn("bad", F.col("spread") > F.col("usual") + cut * F.col("dev"))  # one row per region


def quantal(profile: DataFrame, low: float = 1.5, high: float = 5.5, step: float = 0.05) -> DataFrame:
    """Per sample, the multiplier that brings segment ratios nearest to whole numbers."""
    n = round((high - low) / step)
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.lit(low) + k * step)).alias("multiplier")
    scaled = profile.select("sample", "seg_ratio", grid).withColumn("x", F.col("seg_ratio") * F.col("multiplier"))
    error = scaled.groupBy("sample", "multiplier").agg(F.sum(F.pow(F.col("x") - F.round("x"), 2)).alias("error"))
    return error.groupBy("sample").agg(F.min_by("multiplier", F.struct(F.round("error", 9), "multiplier")).alias("multiplier"))


def segments(profile: DataFrame) -> DataFrame:
    """Runs of equal seg_ratio inside sample and chromosome."""
    return run_lengths(profile, ["sample", "chr"], "bin", "seg_ratio")


def call_states(segs: DataFrame, n_states: int = STATES) -> DataFrame:
    """Most likely copy state of each segment, its score, and what is expected.

    ``segs``: count, n_bins, avg (autosome count per bin), expected (expected
    copies). Squared deviations over expected counts become chi-square tails; the
    exponent falls from 2 by 0.1 until some state has probability.
    """
    names = list(segs.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[names], _states(b, n_states)], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segs.schema)
    got = segs.mapInPandas(run, kinds + ", state int, score double, p_expected double, found boolean").filter("found").drop("found")
    expected = F.round("expected")
    return got.select(
        *segs.columns, "state", (F.col("state") != expected).alias("event"), "score", "p_expected", F.when(F.col("state") > expected, "gain").when(F.col("state") < expected, "loss").otherwise("norm").alias("call"),
    )


def _states(b: pd.DataFrame, n_states: int) -> pd.DataFrame:
    """State, score and probability of the expected state of a batch of segments; all states and segments at once, one exponent after the other."""
    n = len(b)
    state = np.arange(n_states)
    avg, n_bins, count = (b[c].to_numpy(float) for c in ("avg", "n_bins", "count"))
    mean = n_bins[:, None] * np.where(state == 0, avg[:, None] / 10, state * avg[:, None] / 2)
    best, top, total, at_expected = np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n)
    expected = np.floor(b["expected"].to_numpy(float) + 0.5).astype(int)
    todo = np.arange(n)
    for k in range(20):
        power = round(2.0 - 0.1 * k, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.abs(count[todo, None] - mean[todo]) ** power / mean[todo]
        p = chi2_tail_1(x)
        found = p.sum(1) > 0
        at = todo[found]
        best[at], top[at], total[at] = p[found].argmax(1), p[found].max(1), p[found].sum(1)
        known = (expected[at] >= 0) & (expected[at] < n_states)
        at_expected[at] = np.where(known, p[found][np.arange(len(at)), np.where(known, expected[at], 0)], 0.0)
        todo = todo[~found]
        if not len(todo):
            break
    ok = total > 0
    share = np.divide(top, total, out=np.zeros(n), where=ok)
    return pd.DataFrame({"state": best.astype(np.int32), "score": -np.log10(np.maximum(1 - share, 1e-300)), "p_expected": np.divide(at_expected, total, out=np.zeros(n), where=ok), "found": ok}, index=b.index)


def annotate_segments(called: DataFrame, genes: DataFrame) -> DataFrame:
    """Gene names over each segment (chr, start, stop), sorted."""
    hit = genes_in_intervals(called, genes)
    keys = [f"l_{c}" for c in called.columns]
    return hit.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("r_name")), ",").alias("genes")).select(*[F.col(k).alias(k[2:]) for k in keys], "genes")


def population_calls(segs: DataFrame) -> DataFrame:
    """Gains and losses of each segment in each sample by Poisson tails half a copy around what is expected.

    ``segs``: count, n_bins, copy1 (count per bin of one copy), expected.
    """
    f = F.col("count") / (F.col("copy1") * F.col("n_bins"))
    unit = F.col("copy1") * F.col("n_bins")
    called = segs.withColumn("fcopy", f).withColumn("call", F.when(F.col("fcopy") > F.col("expected") + 0.5, "gain").when(F.col("fcopy") < F.col("expected") - 0.5, "loss").otherwise("norm"))
    p_gain = poisson_upper(F.col("count") - 1, (F.col("expected") + 0.5) * unit)
    p_loss = poisson_lower(F.col("count"), F.greatest(F.col("expected") - 0.5, F.lit(0.05)) * unit)
    return called.withColumn("p_null", F.when(F.col("call") == "gain", p_gain).when(F.col("call") == "loss", p_loss).otherwise(1.0))


def population_ranks(called: DataFrame) -> DataFrame:
    """For each segment of each sample: samples with at least as extreme a copy number."""
    w = Window.partitionBy("chr", "start", "stop")
    up, down = w.orderBy(F.desc("fcopy")), w.orderBy("fcopy")
    return called.withColumn("pop_rank", F.when(F.col("call") == "loss", F.rank().over(down)).otherwise(F.rank().over(up)))


def pedigree_calls(called: DataFrame, samples: DataFrame, near: float = 0.25) -> DataFrame:
    """Children's events: transmitted if a parent has the same call or is within ``near`` copies, de novo otherwise."""
    own = called.join(samples.select("sample", "family", "relation"), "sample")
    kids = own.filter("relation = 'child' AND call <> 'norm'")
    parents = own.filter("relation = 'parent'").groupBy("family", "chr", "start", "stop").agg(F.collect_set("call").alias("p_calls"), F.collect_list("fcopy").alias("p_copies"))
    met = kids.join(parents, ["family", "chr", "start", "stop"], "left")
    same = F.coalesce(F.array_contains("p_calls", F.col("call")), F.lit(False)) | F.coalesce(F.exists("p_copies", lambda c: F.abs(c - F.col("fcopy")) <= near), F.lit(False))
    return met.withColumn("transmitted", same).drop("p_calls", "p_copies")


def denovo_events(segs: DataFrame, parents: DataFrame, min_score: float = PASS_SCORE, min_shift: float = 0.6, parent_shift: float = 0.4) -> DataFrame:
    """Passing segments of children without a parent's segment nearby in copy number (overlap and closeness)."""
    passing = segs.filter((F.col("score") > min_score) & (F.abs(F.col("cn") - F.col("expected")) > min_shift))
    met = overlap_join(passing.withColumn("id", F.xxhash64("sample", "chr", "start", "stop")), parents)
    close = met.filter((F.col("l_family") == F.col("r_family")) & (F.abs(F.col("l_cn") - F.col("r_cn")) < parent_shift)).select(F.col("l_id").alias("id")).distinct()
    return passing.withColumn("id", F.xxhash64("sample", "chr", "start", "stop")).join(close, "id", "left_anti").drop("id")


def recurrent_regions(events: DataFrame, n_binnings: int = 1, bin_size: int = 1000, level: float = 5.0) -> DataFrame:
    """Stretches where more than ``level`` events overlap, per call."""
    d = depth(events, bin_size, 1_000_000, n_binnings, ["call"])
    filled = d.select("call", "chr", "bin", "depth").union(d.select("call", "chr", F.col("bin") + 1, F.lit(0.0))).groupBy("call", "chr", "bin").agg(F.max("depth").alias("depth"))
    found = peaks(filled, ["call", "chr"], "bin", "depth", level)
    return found.select("call", "chr", (F.col("start") * bin_size).alias("start"), (F.col("stop") * bin_size).alias("stop"), "height")


def chromosome_means(profile: DataFrame) -> DataFrame:
    return profile.groupBy("sample", "chr").agg(F.avg("ratio").alias("mean_ratio"), F.count("*").alias("n_bins"))


def deviation(segs: DataFrame, drawn: float = 0.5) -> DataFrame:
    """Weighted mean distance of copy number from normal, and segments far enough to be drawn."""
    d = F.abs(F.col("cn") - F.col("norm"))
    return segs.groupBy("sample").agg((F.sum(F.col("n_bins") * d) / F.sum("n_bins")).alias("deviation"), F.count_if(d >= drawn).alias("n_drawn"))


def noise_report(profile: DataFrame) -> DataFrame:
    """Per sample and region: bins, upper median, mean, spread, MAD, lag-1 autocorrelation, segments."""
    w = Window.partitionBy("sample", "region").orderBy("bin")
    rows = profile.withColumn("earlier", F.lag("ratio").over(w)).withColumn("new", F.when(F.lag("seg_ratio").over(w).eqNullSafe(F.col("seg_ratio")), 0).otherwise(1))
    stats = rows.groupBy("sample", "region").agg(
        F.count("*").alias("n_bins"), F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("stdev"), F.corr("ratio", "earlier").alias("autocorrelation"), F.sum("new").alias("n_segments")
    )
    return stats.join(mad(profile, ["sample", "region"], "ratio"), ["sample", "region"])


def sex_copies(densities: DataFrame, factor: float = 2.2) -> DataFrame:
    """Copies of X and Y by density relative to the autosomes, and the sex they spell; columns sample, auto, x, y."""
    copies = lambda c: F.ceil(factor * F.col(c) / F.col("auto")).cast("int")
    n = densities.withColumn("n_x", F.greatest(F.lit(0), copies("x"))).withColumn("n_y", F.greatest(F.lit(0), copies("y")))
    return n.withColumn("sex", F.concat(F.repeat(F.lit("X"), F.col("n_x")), F.repeat(F.lit("Y"), F.col("n_y"))))


def sex_by_ratio(profile: DataFrame, cut: float = 0.3333) -> DataFrame:
    """XY where the mean ratio of Y bins exceeds the cut."""
    y = F.avg(F.when(F.col("region") == "Y", F.col("ratio")))
    return profile.groupBy("sample").agg(y.alias("y_ratio")).withColumn("sex", F.when(F.col("y_ratio") > cut, "XY").otherwise("XX"))


def usual_bins(bins: DataFrame, cuts: dict[str, float]) -> DataFrame:
    """Bins whose length, gc and mappability lie within k deviations (MAD) of their medians."""
    for column, k in cuts.items():
        m = mad(bins, [], column).first()  # one row; as a literal it becomes a plain filter
        if m is not None:
            bins = bins.filter(F.abs(F.col(column) - F.lit(m["median"])) <= k * F.lit(m["mad"]))
    return bins


def stable_bins(profile: DataFrame) -> DataFrame:
    """Bins whose ratios range over the samples by no more than the upper median range of their region."""
    spread = profile.groupBy("bin", "region").agg((F.max("ratio") - F.min("ratio")).alias("range"))
    usual = upper_median(spread, ["region"], "range", "usual")
    return spread.join(F.broadcast(usual), "region").filter(F.col("range") <= F.col("usual"))  # one row per region


def pair_key(fragments: Column) -> Column:
    """Duplicate key of a fragmented read: its sorted (chr, pos - off) pairs; ``fragments`` is an array of structs."""
    return F.sort_array(F.transform(fragments, lambda m: F.struct(m["chr"].alias("chr"), (m["pos"] - m["off"]).alias("start"))))


def merge_fragments(mums: DataFrame) -> DataFrame:
    """Matches of a pair on one diagonal (chr, flip, pos - off) are one fragment; the longest match stands for it."""
    diagonal = F.when(F.col("flipped"), F.col("pos") + F.col("off") + F.col("len")).otherwise(F.col("pos") - F.col("off"))
    return mums.withColumn("diagonal", diagonal).groupBy("pair_id", "read_2", "chr", "flipped", "diagonal").agg(
        F.max_by(F.struct("pos", "off", "len"), F.struct("len", -F.col("pos"))).alias("m"), F.sum("len").alias("total_len"), F.count("*").alias("n")
    ).select("pair_id", "read_2", "chr", "flipped", "m.*", "total_len", "n")


def distinct_fragments(fragments: DataFrame) -> DataFrame:
    """Pairs whose fragments repeat those of a pair with a smaller id are left out."""
    keyed = fragments.groupBy("pair_id").agg(F.collect_list(F.struct("chr", "pos", "off")).alias("f")).withColumn("key", pair_key(F.col("f")))
    first = keyed.groupBy("key").agg(F.min("pair_id").alias("pair_id"))
    return fragments.join(first.select("pair_id"), "pair_id", "left_semi")


def simulate_mixture(spark, n_bins: int, samples: int, share: float, event: tuple[int, int, float], mean: float = 100.0, seed: int = 1) -> DataFrame:
    """Counts per bin of samples in which a share of cells has an event (first bin, last bin, copies)."""
    rows = spark.range(samples).select(F.col("id").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    copies = F.when(F.col("bin").between(event[0], event[1]), 2 * (1 - share) + event[2] * share).otherwise(2.0)
    unit = lambda salt: 1 - uniform(seed, F.lit(salt), F.col("sample"), F.col("bin"))
    normal = F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * math.pi * unit(2))
    m = copies * mean / 2
    return rows.withColumn("expected", m).withColumn("count", F.greatest(F.lit(0), F.round(m + F.sqrt(m) * normal)).cast("long"))
