"""Cuts on bridges by family and population.

``samples``: sample, family, member (mother, father, proband, sibling), relation
(parent or child), sex. It is a cohort's list; the planner broadcasts it where its
size allows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bridges import SIGNATURE, bridge_invariant


@dataclass(frozen=True)
class Cuts:
    """Thresholds of a study. The four named sets below."""

    exclude_snps: bool = True
    min_support: int = 20
    min_bridge_count: int = 5
    min_mate_count: int = 1
    min_mate_support: int = 5
    min_excess: int = 2


POPULATION = Cuts()
DENOVO = Cuts(min_support=25, min_mate_support=20, min_excess=1)
TRANSMISSION = Cuts(min_bridge_count=10, min_mate_support=20, min_excess=0)
RARE = Cuts(min_bridge_count=1, min_mate_support=10, min_excess=5)


@dataclass(frozen=True)
class Mode:
    """Which families and members may have a bridge."""

    two_samples: bool
    one_family: bool
    just_kids: bool
    family_limit: int


#: The study modes.
MODES = {
    "rare_denovo": Mode(False, False, True, 5),
    "ultra_rare_denovo": Mode(True, True, True, 10_000),
    "denovo": Mode(False, False, True, 10_000),
    "ultra_rare": Mode(False, True, False, 10_000),
    "ultra_rare_and_denovo": Mode(False, False, False, 10_000),
}


def families_seen(bridges: DataFrame, samples: DataFrame) -> DataFrame:
    """Per bridge: families, samples, and parent and child totals."""
    own = bridges.join(samples.select("sample", "family", "relation"), "sample")
    parent = F.col("relation") == "parent"
    return own.groupBy(*SIGNATURE).agg(
        F.count_distinct("family").alias("n_families"), F.count("*").alias("n_samples"), F.sum("bridge_count").alias("total"),
        F.coalesce(F.sum(F.when(parent, F.col("bridge_count"))), F.lit(0)).alias("parent_total"), F.coalesce(F.sum(F.when(~parent, F.col("bridge_count"))), F.lit(0)).alias("child_total"),
    )


def family_maxima(bridges: DataFrame, samples: DataFrame) -> DataFrame:
    """Per bridge and family: largest counts and supports, parents and children with it."""
    own = bridges.join(samples.select("sample", "family", "relation", "member"), "sample")
    parent = F.col("relation") == "parent"
    return own.groupBy(*SIGNATURE, "family").agg(
        *[F.max(c).alias(c) for c in ("bridge_count", "anchor1_len", "anchor2_len", "mate1_len", "mate2_len", "mate1_count", "mate2_count")],
        F.count_if(parent).alias("n_parents"), F.count_if(~parent).alias("n_children"), F.coalesce(F.sum(F.when(parent, F.col("bridge_count"))), F.lit(0)).alias("parent_sum"),
    )


def candidates(bridges: DataFrame, samples: DataFrame, mode: str, cuts: Cuts = POPULATION) -> DataFrame:
    """(bridge, family) rows that pass a study mode and its thresholds; the cheap cuts come first."""
    m = MODES[mode]
    rows = bridges.filter(bridge_invariant() != 0) if cuts.exclude_snps else bridges
    fam = family_maxima(rows, samples)
    own = [c for c in fam.columns if c not in SIGNATURE]
    # a bridge's families, at most as many as the cohort has, meet in one row: what all of them say needs no second pass
    met = fam.groupBy(*SIGNATURE).agg(F.collect_list(F.struct(*own)).alias("fams"), F.count("*").alias("n_families"), F.sum(F.col("n_parents") + F.col("n_children")).alias("n_samples"), F.sum("parent_sum").alias("parent_total"))
    if m.one_family:
        met = met.filter("n_families = 1")
    if m.two_samples:
        met = met.filter("n_samples <= 2")
    fam = met.filter(F.col("n_families") <= m.family_limit).select(*SIGNATURE, "n_families", "n_samples", "parent_total", F.inline("fams")).drop("parent_sum")
    ok = F.col("n_parents") == 0 if m.just_kids else F.lit(True)
    if mode == "ultra_rare_and_denovo":
        ok &= ~((F.col("n_families") > 1) & (F.col("n_parents") > 0))
    ok &= (F.col("n_parents") <= 1) & (F.col("bridge_count") >= cuts.min_bridge_count)
    ok &= (F.col("anchor1_len") >= cuts.min_support) & (F.col("anchor2_len") >= cuts.min_support)
    return fam.filter(ok)


def with_mates(rows: DataFrame, cuts: Cuts) -> DataFrame:
    """Cuts on the support that mates add."""
    return rows.filter((F.greatest("mate1_count", "mate2_count") >= cuts.min_mate_count) & (F.greatest("mate1_len", "mate2_len") >= cuts.min_mate_support))


def denovo(bridges: DataFrame, samples: DataFrame) -> DataFrame:
    """Children's bridges that no parent of their family has: an anti-join."""
    own = bridges.join(samples.select("sample", "family", "relation"), "sample")
    kids, parents = own.filter("relation = 'child'"), own.filter("relation = 'parent'").select(*SIGNATURE, "family").distinct()
    return kids.join(parents, [*SIGNATURE, "family"], "left_anti")


def max_other_family(bridges: DataFrame, samples: DataFrame) -> DataFrame:
    """Per (bridge, family): the highest count outside the family.

    The two highest family maxima of a bridge decide it for all its families.
    """
    fam = family_maxima(bridges, samples)
    met = fam.groupBy(*SIGNATURE).agg(F.collect_list(F.struct("family", "bridge_count")).alias("fams"))
    top = F.slice(F.sort_array(F.transform("fams", lambda f: F.struct(f["bridge_count"].alias("bridge_count"), f["family"].alias("family"))), asc=False), 1, 2)
    rows = met.select(*SIGNATURE, top.alias("top"), F.inline("fams"))
    other = F.when(F.col("top")[0]["family"] != F.col("family"), F.col("top")[0]["bridge_count"]).otherwise(F.coalesce(F.get("top", F.lit(1))["bridge_count"], F.lit(0)))
    return rows.select(*SIGNATURE, "family", "bridge_count", other.alias("max_other"))


def transmission(bridges: DataFrame, samples: DataFrame, t1: int = 10, t2: int = 2) -> DataFrame:
    """Bridges of one parent (count >= t1, the other parent <= t2), and how many children of each sex have them."""
    own = bridges.join(samples.select("sample", "family", "relation", "sex"), "sample")
    parent = F.col("relation") == "parent"
    fam = own.groupBy(*SIGNATURE, "family").agg(
        F.max(F.when(parent, F.col("bridge_count"))).alias("parent_max"), F.min(F.when(parent, F.col("bridge_count"))).alias("parent_min"), F.count_if(parent).alias("n_parents"),
        F.count_if(~parent & (F.col("sex") == "XX")).alias("daughters"), F.count_if(~parent & (F.col("sex") == "XY")).alias("sons"),
    )
    return fam.filter((F.col("parent_max") >= t1) & ((F.col("n_parents") < 2) | (F.col("parent_min") <= t2)))


def member_counts(bridges: DataFrame, samples: DataFrame) -> DataFrame:
    """Bridges and pairs per member type and sex."""
    own = bridges.join(samples.select("sample", "member", "sex"), "sample")
    return own.groupBy("member", "sex").agg(F.count("*").alias("n_bridges"), F.sum("bridge_count").alias("n_pairs"), F.max("bridge_count").alias("max_bridge"))
