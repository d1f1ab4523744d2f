"""The k-mer graph against plain Python."""

import random
from collections import Counter, defaultdict

import pytest

from strandlake.operators import assembly


def python_unitigs(counts):
    into, out = defaultdict(list), defaultdict(list)
    for k in counts:
        out[k[:-1]].append(k)
        into[k[1:]].append(k)
    inner = {n for n in set(into) | set(out) if len(into[n]) == 1 and len(out[n]) == 1}
    found, used = [], set()

    def walk(k):
        path = [k]
        while path[-1][1:] in inner and out[path[-1][1:]][0] != k:
            path.append(out[path[-1][1:]][0])
        used.update(path)
        found.append((path[0] + "".join(x[-1] for x in path[1:]), len(path), round(sum(counts[x] for x in path) / len(path), 6), len(into[path[0][:-1]]), len(out[path[-1][1:]])))

    for k in sorted(counts):
        if k[:-1] not in inner:
            walk(k)
    for k in sorted(counts):  # cycles, from their least k-mer
        if k not in used:
            walk(k)
    return sorted(found)


@pytest.mark.parametrize("k", [3, 5, 8])
def test_unitigs(spark, k):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 2, 30, 60, 90)] + ["TTTTGGGGCATTTTGGGG", "ACGGT" * 5]
    counts = Counter(s[i : i + k] for s in seqs for i in range(len(s) - k + 1))
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    got = assembly.edges(df, k)
    assert {r.kmer: r.n for r in got.collect()} == counts
    assert sorted((r.unitig, r.n_edges, round(r.mean_count, 6), r.starts, r.ends) for r in assembly.unitigs(got).collect()) == python_unitigs(counts)
    assert assembly.unitigs(got.limit(0)).count() == 0


def test_cycle_alone(spark):
    ring = "ACGTTGCA"
    df = spark.createDataFrame([((ring * 2)[: len(ring) + 3],)], "seq string")
    (r,) = assembly.unitigs(assembly.edges(df, 4)).collect()
    assert r.n_edges == len(ring) and r.unitig[:4] == min((ring * 2)[i : i + 4] for i in range(len(ring)))


def test_tips(spark):
    main, tip = "ACGTTGCATGCCAGTTAGGATCC", "ACGTTGCATGCCAA"
    df = spark.createDataFrame([(main,), (main,), (main,), (tip,)], "seq string")
    kept = assembly.without_tips(assembly.edges(df, 7), 3, 1.0)
    assert {r.unitig for r in assembly.unitigs(kept).collect()} == {main}


def test_mismatch_counts(spark):
    rng = random.Random(4)
    kmers = sorted({"".join(rng.choice("AC") for _ in range(7)) for _ in range(60)})
    df = spark.createDataFrame([(k, i + 1) for i, k in enumerate(kmers)], "kmer string, n long")
    got = {(r.kmer, r.mismatches): r.n for r in assembly.mismatch_counts(df.select("kmer"), df, 2).collect()}
    want = Counter()
    for a in kmers:
        for i, b in enumerate(kmers):
            d = sum(x != y for x, y in zip(a, b, strict=True))
            if d <= 2:
                want[a, d] += i + 1
    assert got == want
