"""Operators that SQL can't express, against their definitions in plain Python."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import bridges, cn, models, sequence, tables
from strandlake.operators.store import SIGNATURE
from strandlake.plans import registry

SF = "/root/testdata/sf0.001"


def test_state_calls(spark):
    rng = random.Random(4)
    segs = [(i, rng.randint(0, 400), rng.randint(1, 5), float(rng.choice([40, 55, 80])), float(rng.choice([1, 2, 2.5]))) for i in range(60)] + [(99, 10**9, 1, 40.0, 2.0)]
    df = spark.createDataFrame(segs, "id int, count long, n_bins int, avg double, expected double")
    got = {r.id: r for r in cn.call_states(df).collect()}
    for i, count, n_bins, avg, expected in segs:
        for k in range(20):
            e = round(2 - 0.1 * k, 1)
            p = []
            for s in range(20):
                mean = n_bins * (avg / 10 if s == 0 else s * avg / 2)
                p.append(math.erfc(math.sqrt(abs(count - mean) ** e / mean / 2)))
            if sum(p) > 0:
                break
        else:
            assert i not in got
            continue
        state, want = p.index(max(p)), math.floor(expected + 0.5)
        r = got[i]
        assert (r.state, r.event, r.call) == (state, state != want, "gain" if state > want else "loss" if state < want else "norm")
        assert math.isclose(r.p_expected, p[want] / sum(p), abs_tol=1e-9)
        assert math.isclose(r.score, -math.log10(max(1 - max(p) / sum(p), 1e-300)), rel_tol=1e-6, abs_tol=1e-9)


def test_unequal_counts(spark):
    rng = random.Random(8)
    pairs = {0: 100, 1: 300, 2: 50, 3: 200}
    rows, seen = [], defaultdict(dict)
    for k in range(30):
        sig = (0, k, True, 1, 7 * k, False, 3)
        for s in pairs:
            if rng.random() < 0.6:
                seen[sig][s] = rng.randint(1, 30 if rng.random() < 0.4 else 3)
                rows.append((s, *sig, seen[sig][s]))
    df = spark.createDataFrame(rows, "sample int, chr1 int, pos1 long, high1 boolean, chr2 int, pos2 long, high2 boolean, `offset` int, bridge_count int")
    n = spark.createDataFrame(list(pairs.items()), "sample int, n_pairs long")
    got = {tuple(r[c] for c in SIGNATURE): (r.total, r.least, r.most, r.p) for r in bridges.unequal_bridges(df, n, 5, 0.5).collect()}
    cdf = lambda k, m: sum(math.exp(-m + i * math.log(m) - math.lgamma(i + 1)) for i in range(k + 1))
    want = {}
    for sig, counts in seen.items():
        total, p = sum(counts.values()), 1.0
        own = [counts.get(s, 0) for s in pairs]
        for s in pairs:
            k, m = counts.get(s, 0), total * pairs[s] / sum(pairs.values())
            p *= min(1.0, 2 * min(cdf(k, m), 1 - cdf(k - 1, m)))
        if total >= 5 and 10 * min(own) <= max(own) and p < 0.5:
            want[sig] = (total, min(own), max(own), p)
    assert set(got) == set(want) and want
    for k, w in want.items():
        assert got[k][:3] == w[:3] and math.isclose(got[k][3], w[3], rel_tol=1e-6, abs_tol=1e-12)


def test_equal_mass_bins(spark):
    rng = random.Random(2)
    counts = [(c, p, rng.randint(1, 9)) for c in range(3) for p in sorted(rng.sample(range(400_000), 60 * (c + 1)))]
    df = spark.createDataFrame(counts, "chr int, pos long, count long")
    got = [tuple(r) for r in cn.equal_mass_bins(df, 20).orderBy("bin").collect()]
    totals = Counter()
    for c, _, n in counts:
        totals[c] += n
    share = cn.allocate(dict(totals), 20)
    want = []
    for c in sorted(share):
        run, cells = 0, defaultdict(list)
        for _, p, n in sorted(x for x in counts if x[0] == c):
            cells[min(math.floor(run / (totals[c] / share[c]) + 1e-9), share[c] - 1)].append((p, n))
            run += n
        want += [(c, min(p for p, _ in v), max(p for p, _ in v) + 1, sum(n for _, n in v)) for _, v in sorted(cells.items())]
    assert got == [(i, *w) for i, w in enumerate(want)] and len({w[0] for w in want}) == 3


def test_tandem_repeats(spark):
    rng = random.Random(6)
    seqs = {i: "".join(rng.choice("AC") for _ in range(60)) for i in range(8)} | {20: "", 21: "GATGATGATGAT", 22: "AAAA"}
    got = defaultdict(set)
    for r in sequence.tandem_repeats(spark.createDataFrame(list(seqs.items()), "ref int, seq string"), 4, 3).collect():
        got[r.ref].add((r.start, r.total_length, r.motif))
    for k, s in seqs.items():
        runs, taken = set(), []
        for m in range(1, 5):
            for i in range(len(s)):
                n = 0
                while i + m + n < len(s) and s[i + n] == s[i + m + n]:
                    n += 1
                starts = i == 0 or i + m > len(s) or s[i - 1] != s[i - 1 + m]
                if n and starts and n + m >= 3 * m and not any(a <= i and i + m + n <= b for a, b in taken):
                    taken.append((i, i + m + n))
                    motif = s[i : i + m]
                    runs.add((i, n + m, min(motif[j:] + motif[:j] for j in range(m))))
        assert got[k] == runs
    assert got[21] == {(0, 12, "ATG")}


def test_smoothing_is_weighted_least_squares():
    rng = np.random.default_rng(1)
    for n, frac in ((12, 0.5), (40, 0.3), (25, 1.0)):
        x = np.sort(rng.uniform(0, 10, n))
        y = np.sin(x) + rng.normal(0, 0.2, n)
        got = models.lowess_values(x, y, frac, 0, 0.0)
        size = max(2, int(frac * n))
        for i in range(n):
            near = np.sort(np.abs(x - x[i]))
            h = near[size - 1]
            d = np.abs(x - x[i]) / h
            w = np.where(d < 0.999, (1 - d**3) ** 3, 0)
            w[d <= 0.001] = 1.0
            if (w > 0).sum() < 2:
                continue
            slope, at = np.polyfit(x, y, 1, w=np.sqrt(w))
            assert abs(slope * x[i] + at - got[i]) < 1e-6
    line = models.lowess_values(np.arange(50.0), 3 * np.arange(50.0) + 1, 0.2, 3, 2.0)
    assert np.allclose(line, 3 * np.arange(50.0) + 1)
    # an outlier is smoothed away
    y = np.arange(50.0) + rng.normal(0, 0.1, 50)
    y[25] = 500
    assert abs(models.lowess_values(np.arange(50.0), y, 0.3, 5, 0.0)[20] - 20) < 0.5


def test_hmm_posterior_is_that_of_all_paths():
    rng = np.random.default_rng(3)
    draw = lambda *s: (lambda a: a / a.sum(-1, keepdims=True))(rng.uniform(0.1, 1, s))
    start, move, emit = draw(3), draw(3, 3), draw(3, 2)
    seen = np.array([0, 1, 1, 0, 1])
    want = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        p = start[path[0]] * emit[path[0], seen[0]]
        for a, b, o in zip(path, path[1:], seen[1:], strict=False):
            p *= move[a, b] * emit[b, o]
        for k, s in enumerate(path):
            want[k, s] += p
    assert np.allclose(models.Hmm(start, move, emit).posterior(seen), want / want.sum(1, keepdims=True))


@pytest.mark.parametrize("tile", [8, 1 << 24])
def test_neighbours_in_blocks(spark, tile, monkeypatch):
    """Small tiles and many blocks give the rows of one block and one tile, and of brute force."""
    monkeypatch.setattr(models, "KNN_TILE", tile)
    rng = np.random.default_rng(5)
    v = rng.integers(0, 4, (60, 3)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    want = set()
    for i in range(0, 60, 7):
        order = sorted((float(np.sqrt(((v[i] - v[j]) ** 2).sum())), j) for j in range(60))
        want |= {(i, j, k + 1) for k, (_, j) in enumerate(order[:4])}
    for rows in (3, 4096):
        got = models.nearest_neighbours(df.filter("id % 7 = 0"), df, 4, rows).collect()
        assert {(r.query_id, r.point_id, r["rank"]) for r in got} == want and len(got) == len(want)


def test_random_orders(spark):
    df = spark.range(200).select("id", (F.col("id") % 3).alias("k"))
    a, b, c = ([r.id for r in tables.shuffle_rows(d, s, "id").collect()] for d, s in ((df, 1), (df.repartition(5), 1), (df, 2)))
    assert a == b != c and sorted(a) == list(range(200)) != a
    counts = Counter(r.id for s in range(60) for r in tables.subsample(df, 20, s, "id").collect())
    assert max(counts.values()) < 20 and len(counts) > 190  # 6 draws each are expected


def test_queries_of_models_run(spark):
    for name in ("lowess", "cbs", "hmm"):
        assert registry.QUERIES[name](spark, SF).count() > 0
