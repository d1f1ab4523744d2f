"""The match store against the flat operators and plain Python."""

import random

from pyspark.sql import functions as F

from strandlake.operators import bridges, store

FLAT = "pair_id long, ord int, chr int, pos long, len int, flipped boolean, read_2 boolean, off int, read_len int, last_hit boolean"


def made(spark, n=60):
    rng, rows = random.Random(5), []
    for p in range(n):
        for r in (False, True):
            k = rng.randint(0, 4)
            lens = [rng.randint(20, 24) for _ in range(k)]
            for i in range(k):
                o = sum(x["read_2"] is not None and x["pair_id"] == p for x in rows)
                rows.append({"pair_id": p, "ord": o, "chr": rng.randint(0, 1), "pos": 100 * rng.randint(0, 6), "len": lens[i], "flipped": rng.random() < 0.5, "read_2": r,
                             "off": sum(lens[:i]) + i, "read_len": sum(lens) + k - 1, "last_hit": i == k - 1})
    return rows, spark.createDataFrame([tuple(x.values()) for x in rows], FLAT)


def test_layout(spark):
    rows, df = made(spark)
    raw = df.groupBy("pair_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "chr", "pos", "len", "flipped", "read_2"))), lambda m: F.struct(*[m[c].alias(c) for c in ("chr", "pos", "len", "flipped", "read_2")])).alias("raw"))
    got = store.flat(store.laid_out(raw)).select(*df.columns)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(x.values()) for x in rows)
    nested = store.nest(df)
    assert sorted(map(tuple, store.flat(nested).select(*df.columns).collect())) == sorted(tuple(x.values()) for x in rows)
    lens = {r.pair_id: (r.len1, r.len2) for r in store.read_lengths(nested).collect()}
    assert lens == {p: tuple(max([x["read_len"] for x in rows if x["pair_id"] == p and x["read_2"] == t], default=0) for t in (False, True)) for p in {x["pair_id"] for x in rows}}


def test_support_equals_flat(spark):
    _, df = made(spark)
    columns = ["pair_id", "ord", "readpos", "low_support", "high_support", "seen_low", "seen_high", "mate_support"]
    want = bridges.mate_support(bridges.read_support(df)).select(*columns)
    got = store.flat(store.with_support(store.nest(df))).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_bridges_by_hand(spark):
    rows, df = made(spark)
    full = {(r.pair_id, r.ord): r for r in bridges.mate_support(bridges.read_support(df)).collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a["pair_id"] != b["pair_id"] or a["read_2"] != b["read_2"] or a["ord"] >= b["ord"] or a["pair_id"] % 3 == 0 or (a["read_2"] and a["pair_id"] % 5 == 0):
                continue
            x, y = full[a["pair_id"], a["ord"]], full[b["pair_id"], b["ord"]]
            ha, hb = not a["flipped"], b["flipped"]
            p = (a["chr"], a["pos"] + (a["len"] - 1 if ha else 0), ha, x.low_support if ha else x.high_support, 0)
            q = (b["chr"], b["pos"] + (b["len"] - 1 if hb else 0), hb, y.low_support if hb else y.high_support, y.mate_support)
            if p[3] < 21 or q[3] < 21:
                continue
            first = p[0] > q[0] if p[0] != q[0] else p[1] < q[1] if p[1] != q[1] else ha or not hb
            u, v = (p, q) if first else (q, p)
            key = (a["pair_id"], *u[:3], *v[:3], b["off"] - (a["off"] + a["len"] - 1))
            old = want.get(key, (0, 0, 0, 0))
            want[key] = tuple(map(max, old, (u[3], v[3], u[4], v[4])))
    marked = store.nest(df).withColumns({"bad1": F.lit(False), "bad2": F.col("pair_id") % 5 == 0, "dupe": F.col("pair_id") % 3 == 0})
    got = {(r.pair_id, *[r[c] for c in store.SIGNATURE]): tuple(r[c] for c in store.SUPPORT) for r in store.bridges(marked, least=21).collect()}
    assert got == want and len(want) > 50


def test_empty_store(spark):
    df = spark.createDataFrame([], FLAT)
    marked = store.read_lengths(store.nest(df)).withColumns({"bad1": F.lit(False), "bad2": F.lit(False), "sample": F.lit(0)})
    assert store.bridges(store.mark_duplicates(marked), "sample").count() == 0
