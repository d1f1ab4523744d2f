"""Functions on base sequences, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes and their complements.
IUPAC = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn"
IUPAC_COMPLEMENT = "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"


def complement(seq: Column) -> Column:
    return F.translate(seq, IUPAC, IUPAC_COMPLEMENT)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def count_of(seq: Column, letters: str) -> Column:
    """Characters of ``seq`` that are among ``letters``."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def gcat_score(seq: Column) -> Column:
    """Melting score: 2 per A or T, 4 per G or C."""
    return 2 * count_of(seq, "ATat") + 4 * count_of(seq, "GCgc")


def gc_fraction(seq: Column) -> Column:
    known = count_of(seq, "ACGTacgt")
    return F.when(known > 0, count_of(seq, "GCgc") / known)


def bases(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, F.split(seq, "")).otherwise(F.array().cast("array<string>"))


def hamming(a: Column, b: Column) -> Column:
    """Differing positions over the shorter length, plus the difference of lengths."""
    pairs = F.zip_with(bases(a), bases(b), lambda x, y: x.eqNullSafe(y))
    return F.size(F.filter(pairs, lambda same: ~same))


def similarity(a: Column, b: Column, ignored: str = "Nx") -> Column:
    """Matches and testable positions, leaving out those where either side is unknown."""
    skip = [F.lit(c) for c in ignored]
    pairs = F.filter(
        F.zip_with(bases(a), bases(b), lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
        lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~p["x"].isin(*skip) & ~p["y"].isin(*skip),
    )
    return F.struct(F.size(F.filter(pairs, lambda p: p["x"] == p["y"])).alias("matches"), F.size(pairs).alias("testable"))


def kmers(seq: Column, k: int) -> Column:
    """All substrings of length k, in order."""
    n = F.length(seq)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def subsequence(seq: Column, start: Column, stop: Column) -> Column:
    """Half-open [start, stop) from zero."""
    return F.substring(seq, start + 1, stop - start)
