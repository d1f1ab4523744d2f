import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake.functions import coords, distributions, dna, expr, stats
from strandlake.operators import bridges, intervals, models, sequence


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize(("text", "value"), [("3+4-a", 6), ("a*b", -3), ("abc/a+a", 26), ("a+sqrt(a-b)+a", 4), ("pow(a,abc)", 1), ("max3(2, 3, 1)", 3), ("7 % 4", 3), ("2-3-4", -5), ("(2+3)*4", 20)])
def test_expressions(spark, text, value):
    names = {"a": F.lit(1), "b": F.lit(-3), "abc": F.lit(25)}
    assert one(spark, x=expr.compile_expression(text, names)).x == value


@pytest.mark.parametrize("text", ["f ( 2 - 3.7 , x );", "-.2", "-3.2.3", "+", "bad$varname", "", "nope(1)", "max(1)", "(1"])
def test_bad_expressions(spark, text):
    with pytest.raises(ValueError):
        expr.compile_expression(text, {"x": F.lit(1)})


def test_dna(spark):
    s = F.lit("ACGTNRYacgt")
    r = one(spark, twice=dna.reverse_complement(dna.reverse_complement(s)), rc=dna.reverse_complement(F.lit("AACG")), score=dna.gcat_score(F.lit("ATGC")), h=dna.hamming(F.lit("ACGT"), F.lit("AGG")), k=dna.kmers(F.lit("ACGT"), 3), none=dna.kmers(F.lit("AC"), 3))
    assert (r.twice, r.rc, r.score, r.h, r.k, r.none) == ("ACGTNRYacgt", "CGTT", 12, 2, ["ACG", "CGT"], [])
    assert one(spark, s=dna.similarity(F.lit("ACNx"), F.lit("AGAC"))).s == (1, 2)


def test_regions():
    assert coords.parse_region("chr1:1,001-2,000") == ("chr1", 1000, 2000)
    assert coords.parse_region("chr1:5") == ("chr1", 4, 5)
    assert coords.parse_region("chr1") == ("chr1", 0, None)
    for bad in ("chr1:5-4", "chr1:0-4", "a:b"):
        with pytest.raises(ValueError):
            coords.parse_region(bad)


def test_invariant_is_symmetric(spark):
    a, b = (F.lit(True), F.lit(100)), (F.lit(False), F.lit(250))
    r = one(spark, x=coords.invariant(*a, *b, F.lit(3)), y=coords.invariant(*b, *a, F.lit(3)), d=coords.describe(F.lit(1), F.lit(100), F.lit(True), F.lit(1), F.lit(250), F.lit(False), F.lit(3)))
    assert r.x == r.y == -147
    assert r.d == "100s deletion"


def test_upper_median_and_mad(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("b", 5.0), ("b", 7.0), ("b", 7.0), ("c", None)], "k string, v double")
    assert {r.k: (r.median, r.mad) for r in stats.mad(df, ["k"], "v").collect()} == {"a": (3.0, 1.0), "b": (7.0, 0.0)}
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1000, 2001)
    big = spark.createDataFrame(pd.DataFrame({"k": rng.integers(0, 2, 2001), "v": v}))
    wide = {r.k: r.m for r in stats.wide_upper_median(big, ["k"], "v", "m").collect()}
    plain = {r.k: r.m for r in stats.upper_median(big, ["k"], "v", "m").collect()}
    want = big.toPandas().groupby("k").v.apply(lambda x: sorted(x)[len(x) // 2]).to_dict()
    assert wide == plain == want


def test_distributions():
    for mean in (0.5, 3.0, 40.0, 900.0):
        total = 0.0
        for k in range(0, int(mean * 3)):
            total += math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
            assert abs(float(distributions.poisson_cdf(np.array([k]), np.array([mean]))[0]) - total) < 1e-9
    assert distributions.binomial_two_sided(0, 4) == 0.125


def python_mate_support(rows):
    """The definition, match by match."""
    out = {}
    for m in rows:
        readpos = lambda x: x["pos"] - x["read_len"] + x["off"] + x["len"] if x["flipped"] else x["pos"] - x["off"]
        lo, hi = m["pos"], m["pos"] + m["len"] - 1
        for x in rows:
            if x["read_2"] == m["read_2"] and (x["chr"], x["flipped"], readpos(x)) == (m["chr"], m["flipped"], readpos(m)):
                lo, hi = min(lo, x["pos"]), max(hi, x["pos"] + x["len"] - 1)
        n = 0
        for x in sorted((x for x in rows if x["read_2"] != m["read_2"]), key=lambda x: -x["ord"]):
            end = x["pos"] + x["len"] - 1
            if x["chr"] != m["chr"] or x["flipped"] == m["flipped"]:
                continue
            if not m["flipped"]:
                if end <= hi or x["pos"] > m["pos"] + 1000:
                    continue
                n += end - max(hi + 1, x["pos"]) + 1
            else:
                if x["pos"] >= lo or m["pos"] > x["pos"] + 1000:
                    continue
                n += min(lo, end + 1) - x["pos"]
            lo, hi = min(lo, x["pos"]), max(hi, end)
        out[m["ord"]] = n
    return out


def test_mate_support(spark):
    rng = np.random.default_rng(3)
    rows = []
    for pair in range(40):
        off = {False: 0, True: 0}
        mine = []
        for o in range(int(rng.integers(2, 8))):
            second = bool(rng.integers(0, 2))
            n = int(rng.integers(20, 40))
            mine.append(dict(pair_id=pair, ord=o, chr=int(rng.integers(0, 2)), pos=int(rng.integers(0, 60)) * 25, off=off[second], len=n, flipped=bool(rng.integers(0, 2)), read_2=second))
            off[second] += n
        for m in mine:
            m["read_len"] = max(x["off"] + x["len"] for x in mine if x["read_2"] == m["read_2"])
        rows += mine
    df = spark.createDataFrame(rows, "pair_id long, ord int, chr int, pos long, off int, len int, flipped boolean, read_2 boolean, read_len int")
    got = {(r.pair_id, r.ord): r.mate_support for r in bridges.mate_support(bridges.read_support(df)).collect()}
    want = {(p, o): n for p in range(40) for o, n in python_mate_support([r for r in rows if r["pair_id"] == p]).items()}
    assert got == want
    assert any(want.values())


def test_mappability(spark):
    rng = np.random.default_rng(5)
    seqs = ["".join(rng.choice(list("ACGT"), 300)) for _ in range(3)]
    seqs[1] = seqs[1][:100] + seqs[0][50:150] + seqs[1][100:]
    ref = spark.createDataFrame(list(enumerate(seqs)), "ref int, seq string")
    rows = lambda df: sorted(map(tuple, df.select("ref", "pos", "low", "high").collect()))
    assert rows(sequence.mappability(ref)) == rows(sequence.mappability_small(ref))


def test_models(spark):
    x = np.arange(50.0)
    assert np.allclose(models.lowess_values(x, 2 * x + 1, 0.3, 2, 0.0), 2 * x + 1)
    y = np.r_[np.zeros(60), np.ones(40) * 3, np.zeros(50)] + np.random.default_rng(0).normal(0, 0.2, 150)
    assert models.cbs_cuts(y) == [60, 100]
    h = models.Hmm(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([[0.9, 0.1], [0.1, 0.9]]))
    seen = np.array([0] * 10 + [1] * 10)
    assert list(h.posterior(seen).argmax(1)) == [0] * 10 + [1] * 10
    assert np.isfinite(h.fitted(seen, 3).move[0]).any()


def test_interval_edges(spark):
    iv = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 15, 30), (2, 5, 6)], "chr int, start long, stop long")
    assert sorted((r.chr, r.start, r.stop) for r in intervals.merge_intervals(iv).collect()) == [(1, 0, 30), (2, 5, 6)]
    pts = spark.createDataFrame([(1, 9), (1, 10), (1, 30), (3, 1)], "chr int, pos long")
    hit = sorted((r.pos, r.r_start) for r in intervals.point_join(pts, iv, width=4).collect())
    assert hit == [(9, 0), (10, 10)]
    gaps = iv.withColumn("type", F.lit("t"))
    assert {(r.chr, r.pos): r.distance for r in intervals.nearest_gap(pts, gaps, rows_per_bin=1).collect()} == {(1, 9): 0, (1, 10): 0, (1, 30): 1, (3, 1): 10**9}
