"""The training-data operators on small fixtures, against brute force, round trips and held-out rows."""

import gzip
import itertools
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm import decontam, exact_dedup, html_text, langid, licenses, mixing, queries, simhash, token_files, toxicity, warc
from strandlake.llm.common import fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
LONG = "longword " * 40_000


def docs(spark, texts, sources=None, langs=None):
    rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def messy(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    df = docs(spark, ["a b c d e f", "a b c d e f", "A  B\nC d e f", "", None, " \t\n", LONG, "x", "the quick brown fox jumps over"])
    df = df.union(df.filter("doc_id IN (0, 4)")).union(spark.createDataFrame([(None, "orphan text", None, None, None), (None, None, None, None, None)], SCHEMA))
    return df.withColumns({"digest": F.lit("x"), "size": F.lit(7), "target": F.lit(None).cast("double"), "fp": F.lit(1), "component_id": F.lit(9), "keep": F.lit("k"), "score": F.lit(0.5), "a.b": F.lit(1)})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# exact dedup


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    return {k: (min(v)[2] if not min(v)[1] else None, len(v)) for k, v in groups.items()}


def test_exact_dedup_messy(spark):
    df = messy(spark)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute_groups(rows)
    out = exact_dedup.dedup(df).collect()
    assert len(out) == len(rows)
    kept = Counter(r.digest for r in out if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(want)
    by_id = {r.doc_id: (r.keep_id, r.group_size) for r in out}
    for i, t in rows:
        if i is not None:
            assert by_id[i] == want[re.sub(r"[\x20\x09-\x0D]", "", t or "")]
    stays = exact_dedup.distinct_documents(df)
    assert stays.columns == df.columns and stays.count() == len(want)


def test_exact_dedup_empty_and_batches(spark):
    assert exact_dedup.dedup(empty(spark)).count() == 0
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(6)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(df, files_per_batch=1).collect()}
    want = brute_groups([(r.doc_id, r.text) for r in df.collect()])
    key = {r.doc_id: re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in df.collect()}
    assert got == {i: (*want[k], want[k][0] == i) for i, k in key.items()}


def test_exact_dedup_checks_bytes(spark):
    """A digest of one character makes different texts collide; the byte check tells them apart."""
    df = docs(spark, ["aa", "ab", "a a", "ba", "ac", "ab"])
    weak = lambda text: F.substring(exact_dedup.normalised(text), 1, 1)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(df, weak).collect()}
    assert got == {0: (2, 2, False), 2: (2, 2, True), 1: (1, 2, True), 5: (1, 2, False), 3: (3, 1, True), 4: (4, 1, True)}


def test_exact_dedup_byte_check_beyond_broadcast(spark, monkeypatch):
    """More hits than are broadcast: hot groups and others are checked apart, with the same result."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_HITS", 3)
    weak = lambda text: F.substring(exact_dedup.normalised(text), 1, 1)
    df = docs(spark, [f"{c}{'x' * (i % 2 if c in 'ad' else 0)}" for c in "abcdef" for i in range(12 if c == "a" else 3)])
    got = Counter(r.group_size for r in exact_dedup.dedup(df, weak).collect() if r.kept)
    assert got == {6: 2, 3: 4, 1: 1, 2: 1}


def test_exact_dedup_goes_on(spark, tmp_path):
    """A second call with the same state folder judges its rows against those of the first."""
    first, second = docs(spark, ["a b", "c", "d"]), spark.createDataFrame([(7, "ab", "en", "s", 2), (8, "e", "en", "s", 1), (9, "a  b ", "en", "s", 5), (10, "e", "en", "s", 1)], SCHEMA)
    state = f"file://{tmp_path}/state"
    one = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(first, state=state).collect()}
    assert one == {0: (0, 1, True), 1: (1, 1, True), 2: (2, 1, True)}
    two = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(second, state=state).collect()}
    assert two == {7: (9, 3, False), 9: (9, 3, True), 8: (8, 2, True), 10: (8, 2, False)}
    third = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(docs(spark, ["ab"]), state=state).collect()}
    assert third == {0: (9, 4, False)}


def test_shared_folder(spark):
    from strandlake.llm.common import shared_dir

    before = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark, "x").startswith(before)


# SimHash


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=3):
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (rows[a][1] ^ rows[b][1]).bit_count() <= radius:
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, least.get(find(k))) for k, (i, _) in enumerate(rows)]


def test_simhash_messy(spark):
    df = messy(spark)
    out = simhash.near_duplicates(df).collect()
    want = brute_components([(r.doc_id, slow_fingerprint(r.text)) for r in df.collect()])
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or 0)
    assert sorted(((r.doc_id, r.component_id) for r in out), key=key) == sorted(want, key=key)
    assert {r.doc_id: r.fp & (2**64 - 1) for r in out if r.doc_id is not None} == {r.doc_id: slow_fingerprint(r.text) for r in df.collect() if r.doc_id is not None}
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.distinct_documents(df).columns == df.columns


@pytest.mark.parametrize(("tile", "blocks"), [(simhash.TILE, None), (16, 4), (4, 5), (64, 6)])
def test_links_in_tiles(spark, tile, blocks):
    """Clustered fingerprints, cut into tiles of several sizes: the components are those of all pairs."""
    rng = np.random.default_rng(11)
    centres = rng.integers(0, 2**64, 12, dtype=np.uint64)
    fp = [int(c) for c in centres]
    for c in centres:
        for _ in range(25):
            fp.append(int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)))
    fp = sorted({f - 2**64 if f >= 2**63 else f for f in fp})
    from strandlake.llm.components import components

    df = spark.createDataFrame([(f,) for f in fp], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(df, blocks=blocks, tile=tile)).collect()}
    want = dict(brute_components([(f, f & (2**64 - 1)) for f in fp]))
    assert {f: roots.get(f, f) for f in fp} == want


# mixing


def test_targets():
    got = mixing.targets([("b", 10), ("a", 100), (None, 50), ("c", 1000)])
    assert abs(sum(got.values()) - 1160) < 1e-9
    assert got["b"] == 30 and got["c"] <= 3000 and got["a"] == 300
    assert got[None] == 150 and abs(got["c"] - 680) < 1e-9
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_fit_lengths():
    rng = np.random.default_rng(2)
    for _ in range(50):
        hist = [(int(a), int(rng.integers(1, 4))) for a in rng.choice(np.arange(1, 12), 3, replace=False)]
        budget = int(rng.integers(1, 25))
        sums = {sum(a * k for (a, _), k in zip(hist, ks, strict=True)) for ks in itertools.product(*[range(n + 1) for _, n in hist])}
        best = min(abs(s - budget) for s in sums if s <= 2 * budget)
        got = mixing.fit_lengths(hist, budget)
        assert abs(sum(a * k for a, k in got.items()) - budget) == best
        assert all(k <= dict(hist)[a] for a, k in got.items())


def test_mix(spark):
    rng = np.random.default_rng(4)
    texts = ["w " * int(n) for n in rng.integers(0, 60, 600)]
    df = docs(spark, texts, [f"s{int(x)}" if x < 5 else None for x in np.minimum(rng.integers(0, 9, 600), 5)])
    a, b = (mixing.mixed_sizes(d).toPandas() for d in (df, df.repartition(5)))
    order = lambda p: p.sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(order(a), order(b))
    assert (a["size"] == a.doc_id.map(lambda i: len(texts[i].split()))).all()
    assert (a.taken <= 3 * a["size"]).all()
    sums = a.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((sums.taken - sums.target).abs() <= 1).all()
    m = mixing.mix(messy(spark))
    assert m.count() == messy(spark).count()
    assert m.columns == [{"size": "input_size", "target": "input_target"}.get(c, c) for c in messy(spark).columns] + list(mixing.RESULT)
    assert {r[0] for r in m.select("input_size").collect()} == {7}
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_sizes(empty(spark)).count() == 0


def test_mix_of_repeated_rows(spark, monkeypatch):
    """Rows that repeat are decided one by one: targets are met, however they are laid out and numbered."""
    monkeypatch.setattr(mixing, "SLICE", 7)
    rows = [(1, "w " * 10, "en", "a", 0)] * 100 + [(None, "v " * 3, "en", "b", 0)] * 50 + [(i, "u " * 10, "en", "c", 0) for i in range(30)] + [(2, None, "en", None, 0)] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    seen = []
    for d in (df.repartition(3), df.coalesce(1)):
        a = mixing.mixed_sizes(d).toPandas()
        assert len(a) == len(rows)
        sums = a.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), least=("size", "min"))
        assert ((sums.taken - sums.target).abs() <= sums.least / 2 + 1e-9).all()
        seen.append(Counter((r.doc_id if r.doc_id == r.doc_id else None, r.copies) for r in a.itertuples()))
        b = Counter(r.copies for r in mixing.mix(d).collect())
        assert b == Counter(a.copies)
    assert seen[0] == seen[1]


# decontamination


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    moved = " ".join([*w[10:], "and", "then", *w[:10]])
    partial = " ".join(w[:12]) + " other words"
    shuffled = " ".join(w[::-1])
    df = docs(spark, [f"intro {item} outro", f"x {moved} y", partial, shuffled, "", None, "tiny item", LONG + item + LONG, " ".join(w[:16]) + " end", item.upper(), "such a Tiny, item here"])
    bench = spark.createDataFrame([(1, item, 0), (2, "tiny item", 0), (3, None, 0), (4, "", 0)], "item_id long, text string, coverage int")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(df, bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (6, 2), (7, 1), (8, 1), (9, 1), (10, 2)}
    assert got[1, 1].n_tiles == 2 and got[1, 1].coverage == 1.0 and got[8, 1].coverage == 0.8
    blocked = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench, block_chars=20).collect()}
    assert blocked == set(got)
    for chars in (10**6, 20):
        assert sorted(r.doc_id for r in decontam.clean_documents(df, bench, block_chars=chars).collect()) == [2, 3, 4, 5]
    assert decontam.contaminated(messy(spark), bench).count() == 0
    assert decontam.clean_documents(messy(spark), bench).count() == messy(spark).count()
    assert decontam.contaminated(empty(spark), bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


def slow_tiles(doc, item, least):
    """Greedy string tiling without hashing: the covered item words."""
    fd, fi, total = [True] * len(doc), [True] * len(item), 0
    while True:
        best, found = least - 1, []
        for a in range(len(doc)):
            for b in range(len(item)):
                m = 0
                while a + m < len(doc) and b + m < len(item) and doc[a + m] == item[b + m] and fd[a + m] and fi[b + m]:
                    m += 1
                if m > best:
                    best, found = m, [(a, b)]
                elif m == best and m >= least:
                    found.append((a, b))
        if best < least:
            return total
        for a, b in found:
            if all(fd[a : a + best]) and all(fi[b : b + best]):
                fd[a : a + best] = [False] * best
                fi[b : b + best] = [False] * best
                total += best


def test_tiles_are_greedy():
    rng = np.random.default_rng(8)
    for _ in range(60):
        doc, item = rng.integers(0, 3, 40), rng.integers(0, 3, 15)
        got = decontam.tiles(doc, item, 3)
        for a, b, m in got:
            assert (doc[a : a + m] == item[b : b + m]).all()
        assert len({x for a, _, m in got for x in range(a, a + m)}) == sum(m for *_, m in got) == len({x for _, b, m in got for x in range(b, b + m)})
        assert max([m for *_, m in got], default=0) == max((m for m in range(3, 16) if set(zip(*[doc[i:] for i in range(m)], strict=False)) & set(zip(*[item[i:] for i in range(m)], strict=False))), default=0)
        assert sum(m for *_, m in got) == slow_tiles(doc.tolist(), item.tolist(), 3)


def test_tiles_of_repetitive_texts():
    """Periodic sequences: the same coverage as the slow version, and long ones end soon."""
    for n, m, p, q in itertools.product((9, 40), (7, 23), (1, 2, 5), (1, 3, 4)):
        doc, item = np.arange(n) % p, np.arange(m) % q
        assert sum(x for *_, x in decontam.tiles(doc, item, 3)) == slow_tiles(doc.tolist(), item.tolist(), 3)
    began = time.time()
    assert sum(m for *_, m in decontam.tiles(np.zeros(20_000, int), np.zeros(1000, int), 5)) == 1000
    assert sum(m for *_, m in decontam.tiles(np.arange(20_000) % 7, np.arange(1000) % 5, 5)) == 1000
    assert time.time() - began < 2
    cyclic = " ".join(f"w{i % 7}" for i in range(20_000))
    assert decontam.Index([(1, " ".join(f"w{i % 5}" for i in range(1000)))], 5, 0.8).hits(cyclic)[0][1] == 1.0


def test_seeds_bound_the_coverage():
    """The vectorised bound of an item's covered words is that of sets."""
    rng = np.random.default_rng(3)
    draw = lambda n: " ".join(rng.choice(list("abc"), n))
    items = [(i, draw(int(rng.integers(1, 25)))) for i in range(30)]
    index = decontam.Index(items, 3, 0.8)
    for _ in range(60):
        doc = draw(int(rng.integers(0, 40)))
        want = []
        for i, t in items:
            w, d = t.split(), doc.split()
            short = len(w) < 3 and any(d[k : k + len(w)] == w for k in range(len(d)))
            ids = {x: k for k, x in enumerate("abc")}
            n = len(w) if short else slow_tiles([ids[x] for x in d], [ids[x] for x in w], 3)
            if short or len(w) >= 3 and n >= 0.8 * len(w):
                want.append((i, n))
        assert [(h[0], h[2]) for h in index.hits(doc)] == want


# toxicity and language


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    calm, rude = [f"word{i}" for i in range(200)], ["grobvane", "grobtils", "grobmorn", "idiot"]
    texts, toxic = [], []
    for _ in range(500):
        bad = rng.random() < 0.25
        texts.append(" ".join([*rng.choice(calm, 30), *(rng.choice(rude, 2) if bad else [])]))
        toxic.append(int(bad))
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic) if zlib.crc32(str(i).encode()) % 5] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((model.score(texts[i]) >= 0.5) == bool(toxic[i]) for i in held)
    assert model.score("word1 grobnews word2") > 2 * model.score("word1 word2")  # an unseen word with a known beginning
    assert 1 <= len(model.voters) <= toxicity.MAX_VOTERS and (model.labels.parent >= 0).any()
    rows = toxicity.score(messy(spark), model).collect()
    assert len(rows) == messy(spark).count() and all(0 <= r.score < 0.5 for r in rows)
    assert toxicity.score(empty(spark), model).count() == 0
    assert toxicity.clean_documents(df, model).count() == toxic.count(0)
    lone = toxicity.fit(df, labels.filter("toxic = 0"))
    assert lone.score("you idiot") > 0.5 > lone.score("hello")
    assert toxicity.fit(empty(spark), labels).score(None) < 0.5


def test_label_model_learns_rates():
    rng = np.random.default_rng(9)
    y = rng.random(3000) < 0.2
    fires = np.stack([np.where(y, rng.random(3000) < p, rng.random(3000) < q) for p, q in ((0.8, 0.05), (0.6, 0.02), (0.5, 0.5))], 1).astype(float)
    fires = np.column_stack([fires, fires[:, 0]])  # a copy of the first voter
    given = np.where(rng.random(3000) < 0.05, ~y, y).astype(int)
    m = toxicity.LabelModel(fires, given)
    assert abs(m.rates[1][0] - 0.8) < 0.1 and abs(m.rates[0][1] - 0.02) < 0.03
    # the copy hangs on its source and adds nothing; the others are told independent
    assert m.parent.tolist() == [-1, -1, -1, 0] and m.correlation[0, 3] > 0.99 and abs(m.correlation[0, 1]) < 0.1
    alone = toxicity.LabelModel(fires[:, :3], given)
    assert np.abs(alone.posterior(fires[:, :3], given) - m.posterior(fires, given)).max() < 0.02
    assert ((m.posterior(fires, given) >= 0.5) == y).mean() > (given == y).mean()


def test_language(spark):
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op10_language(spark, "/root/testdata/sf0.01").join(docs_.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    held = out[out.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert held.score.between(0, 1).all()
    model = langid.fit(docs_.filter(fold(F.col("doc_id"), 3) != 1))
    assert [level for level, *_ in model.machines] == [None, "germanic", "romance"]
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs(spark, ["123 ... !?", "", None, "die und der nicht"]), model).collect()}
    assert odd[0] == odd[1] == odd[2] == ("und", 0.0) and odd[3][0] == "de"
    assert langid.predict(messy(spark), model).count() == messy(spark).count()
    none = langid.fit(empty(spark))
    assert {r.lang_pred for r in langid.predict(messy(spark), none).collect()} == {"und"}
    pair = langid.fit(docs(spark, ["1 2 3", "noch einer", "und das"], langs=["nl", "de", "de"]))  # a language without any letter
    assert langid.predict(docs(spark, ["abc"]), pair).first().lang_pred == "de"
    single = langid.fit(docs(spark, ["ein text", "noch einer"], langs=["de", "de"]))
    assert langid.predict(docs(spark, ["abc"]), single).first().lang_pred == "de"


def test_features_of_pieces(monkeypatch):
    text = "Größe und Maß, straße!" * 20
    whole = langid.features(text)
    monkeypatch.setattr(langid, "_PIECE", 37)
    cut = langid.features(text)
    assert (whole[0] == cut[0]).all() and np.allclose(whole[1], cut[1])


# licences, html, tokens, WARC


def brute_windows(text, template, threshold):
    """(dice, start, words) of the best window: every window of every size, counted by multisets."""
    cut = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    pairs = lambda w: list(zip(w, w[1:], strict=False))
    own, words = Counter(pairs(cut(template))), cut(text)
    p, m, best = pairs(words), sum(own.values()), None
    for a in range(len(p)):
        for e in range(a, len(p)):
            n = e - a + 1
            dice = 2 * sum((Counter(p[a : e + 1]) & own).values()) / (m + n)
            if dice >= threshold and (best is None or (dice, -a, -n) > best[0]):
                best = (dice, -a, -n), " ".join(words[a : e + 2])
    return best and (best[1], round(best[0][0], 9), -best[0][1])


def test_licenses(spark):
    line = "Licensed under the Apache License, Version 2.0."
    inside = f"Copyright 2024 Someone. {line} See LICENSE for the details of this project, or ask."
    wrapped = "# Licensed under the\n#  Apache License,\n * Version 2.0\n\nint main();"
    texts = [f"some text\n{line}\nmore", "nothing here at all", None, "", line, "Released under the MIT Licence.", "word", LONG, inside, wrapped, f"{line} {line}", "x " * 30_000 + inside]
    got = {(r.doc_id, r.license, r.segment, round(r.dice, 3)) for r in licenses.scan(docs(spark, texts)).collect()}
    assert got == {(i, "Apache-2.0", "licensed under the apache license version 2 0", 1.0) for i in (0, 4, 8, 9, 10, 11)} | {(5, "MIT", "released under the mit", 0.857)}  # 3 of 3 and 4 pairs
    own = spark.createDataFrame([(1, "X", "a a b a a b"), (2, "Y", "a"), (3, None, None), (4, "X", "")], "template int, license string, text string")
    hits = {(r.doc_id, round(r.dice, 3)) for r in licenses.scan(docs(spark, ["a a b a a b", "a a b a a c", "b a a b a a b a"]), own, 0.5).collect()}
    assert hits == {(0, 1.0), (1, 0.889), (2, 1.0)}
    assert licenses.scan(messy(spark)).count() == 0 and licenses.scan(empty(spark)).count() == 0
    assert licenses.scan(docs(spark, texts), own.limit(0)).count() == 0
    # ties and repeated rows are reported each
    twins = spark.createDataFrame([(1, "X", "one two three four"), (2, "Y", "one two three four")], "template int, license string, text string")
    same = docs(spark, ["zero one two three four five"])
    assert Counter((r.doc_id, r.template, r.start) for r in licenses.scan(same.union(same), twins).collect()) == {(0, 1, 1): 2, (0, 2, 1): 2}


def test_licenses_are_best_windows(spark):
    """Random texts of few words, in one block of templates and in many, against every window of every size."""
    rng = np.random.default_rng(21)
    draw = lambda n: " ".join(rng.choice(["ab", "ba", "license", "the", "of"], n))
    texts, own = [draw(int(n)) for n in rng.integers(1, 40, 60)], [draw(int(n)) for n in rng.integers(2, 12, 6)]
    t = spark.createDataFrame([(i, "L", x) for i, x in enumerate(own)], "template int, license string, text string")
    for threshold, chars in ((0.8, 10**6), (0.6, 40)):
        want = {(d, k): w for d, x in enumerate(texts) for k, y in enumerate(own) if (w := brute_windows(x, y, threshold))}
        got = {(r.doc_id, r.template): (r.segment, round(r.dice, 9), r.start) for r in licenses.scan(docs(spark, texts), t, threshold, chars).collect()}
        assert got == want


def test_main_text(spark):
    page = """<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><header><p>Site name and its long motto for all.</p></header><div class="ad">Buy now.</div>
    <article><h1>Head &amp; line</h1><p>One <b>bo</b>ld  word.<br>Next&#33;<p>Short.<script>var x = "</p>";</script><div class="share-links">Share this story with all of your friends today</div><p>Last one.</article>
    <aside>More stories from around the web that you may like</aside><section id="comments"><p>First! I really do like this article a lot.</p></section><form>Your mail <input></form><footer>&copy; me</footer></body></html>"""
    assert html_text.main_text(page) == "Head & line One bold word. Next! Short. Last one."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<div") == ""
    assert html_text.main_text("<article><p>cut off <!-- open") == "cut off"
    pages = spark.createDataFrame([(1, "u", page, 0), (1, "u", page, 0), (2, None, None, 0), (None, "v", "<p", 0)], "page_id long, url string, html string, text int")
    rows = html_text.extract(pages).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows)
    assert html_text.extract(pages.limit(0)).count() == 0
    assert html_text.default_tree().nodes[0][0] >= 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<main><nav>Home News</nav><p>Text here.</p></main>", "Text here."),
        ("<article><p>One.</p><form><p>Your mail</p></form><p>Two.</p><footer>me</footer><aside>side text</aside></article>", "One. Two."),
        ('<main><p>T.</p><section class="reader-opinions"><p>I think so too, and so do all of my friends.</p></section></main>', "T."),
        ("<body><p>short paragraph</p><p>Another one.</p></body>", "short paragraph Another one."),
        ('<article class="story privacy-law"><p>Kept.</p></article>', "Kept."),
        ('<form id="f"><main><p>In a form.</p></main></form>', "In a form."),
        ('<aside><article><p>Read this too, it is about the sea.</p></article></aside><article><p>Main.</p></article>', "Main."),
        ('<article><h1><a href="/x">Linked title</a></h1><p>Body.</p><p><a href="/y">The source</a></p></article>', "Linked title Body. The source"),
        ('<ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li></ul><p>A page without any telling element, but with a paragraph.</p>', "A page without any telling element, but with a paragraph."),
        ('<article><p>It said so.</p></article><div class="comments"><article><p>No!</p></article></div>', "It said so."),
        ('<header><p>Motto of the site</p></header><p>Text of the page.</p>', "Text of the page."),
        ("<article><header><h1>Own head</h1></header><p>Body.</p></article>", "Own head Body."),
        ("bare text", "bare text"),
    ],
)
def test_main_text_by_contract(page, want):
    assert html_text.main_text(page) == want


def test_tree_uses_words_and_links():
    tree = html_text.default_tree()
    used = {html_text.FEATURES[k] for k, *_ in tree.nodes if k >= 0}
    assert {"words", "links"} <= used and used & {"words_before", "links_before"} and used & {"words_after", "links_after"}
    assert "main" in html_text.described()


def test_main_text_of_pages(spark):
    from html import unescape

    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    for h in pages.html:
        inner = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inner))).split())
        assert html_text.main_text(h) == want


def test_token_counts(spark):
    df = messy(spark)
    coder = token_files._encoder(open(token_files.RANKS, "rb").read())
    want = Counter((r.doc_id, len(coder.encode_ordinary(r.text or ""))) for r in df.collect())
    for block in (7, 1000, token_files.BLOCK_TOKENS):  # blocks that cut through documents
        got = token_files.count_tokens(df.repartition(3), block_tokens=block)
        assert Counter((r.doc_id, r.n_tokens) for r in got.collect()) == want
    assert token_files.count_tokens(empty(spark)).count() == 0


def test_tokens_of_long_runs(monkeypatch):
    coder = token_files._encoder(open(token_files.RANKS, "rb").read())
    for text in (" " * 2_000_000, "a" + " \n" * 1_000_000 + "b", "x" * 2_000_000, "7" * 2_000_000):
        assert coder.decode(token_files.encode(coder, text)) == text
    monkeypatch.setattr(token_files, "_LONG_SPACE", re.compile(token_files._LONG_SPACE.pattern.replace("1000,", "2,")))
    rng = np.random.default_rng(5)
    for _ in range(200):
        text = "".join(rng.choice(["ab", " ", "  ", "\n", "\t\t", "1", "!", "\u3000", "\x1f"], int(rng.integers(0, 25))))
        assert token_files.encode(coder, text) == coder.encode_ordinary(text)
    assert token_files.encode(coder, None) == []


def test_open_tail(spark, tmp_path):
    np.array([1, 2, 9, 9, 3, 3, 3, 9, 4], "<u2").tofile(tmp_path / "tokens-a.bin")
    (tmp_path / "tokens-b.bin").touch()
    for block in (1, 2, 4, 100):
        got = sorted((r.ordinal, r.start, r.n_tokens, r.closed) for r in token_files.scan(spark, f"file://{tmp_path}", 9, block_tokens=block).collect())
        assert got == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 3, True), (3, 8, 1, False)]


def test_warc_resolution(spark, monkeypatch):
    monkeypatch.setattr(warc, "KEYS_PER_BUCKET", 3)
    rng = np.random.default_rng(12)
    rows = []
    for i in range(300):
        url = [f"http://a.org/p{int(rng.integers(0, 4))}", None][int(rng.random() < 0.03)]
        status = 200 if rng.random() < 0.5 else 304
        tag = f'"t{int(rng.integers(0, 2))}"'
        rows.append((i, url, None if rng.random() < 0.03 else int(rng.integers(0, 120)), status, {"etag": tag, "date": f"d{i}", "content-length": str(i)} if rng.random() < 0.9 else {}))
    df = spark.createDataFrame(rows, T._parse_datatype_string(warc.CAPTURE))
    out = {r.record_id: r for r in warc.resolve(df.withColumn("outcome", F.lit(1))).collect()}
    for i, url, ts, status, headers in rows:
        if status != 304:
            assert i not in out
            continue
        earlier = [(t, j, h) for j, u, t, s, h in rows if s == 200 and u and u == url and t is not None and ts is not None and t < ts]
        r = out[i]
        if not earlier:
            assert r.outcome == "orphan"
            continue
        t, j, h = max(earlier, key=lambda x: x[:2])
        if "etag" in headers and headers["etag"] != h.get("etag"):
            assert r.outcome == "mismatch" and r.source_record is None
        else:
            assert (r.outcome, r.source_record, r.source_ts) == ("resolved", j, t)
            assert r.merged_headers == h | {k: v for k, v in headers.items() if k in warc.PERMITTED}
    assert warc.resolve(df.limit(0)).count() == 0


def test_canonical_url(spark):
    urls = ["HTTP://WWW.A.org:80/x/?b=2&a=1&utm_source=q#f", "https://a.org/x?a=1&b=2", "https://a.org/x/", "nonsense", None]
    got = [r.u for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").orderBy("i").select(warc.canonical_url(F.col("url")).alias("u")).collect()]
    assert got == ["a.org/x?a=1&b=2", "a.org/x?a=1&b=2", "a.org/x", None, None]


def test_read_warc(spark, tmp_path):
    def record(kind, body):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://a.org/\r\nWARC-Date: 2024-01-01T00:00:0{len(kind) % 10}Z\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    full = record("response", b"HTTP/1.1 200 OK\r\nETag: \"x\"\r\nContent-Type: text/html\r\n\r\n<p>hi</p>")
    again = record("revisit", b"HTTP/1.1 304 Not Modified\r\nETag: W/\"x\"\r\nDate: now\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in (record("warcinfo", b"software: x"), again, full)))
    (tmp_path / "b.warc").write_bytes(full[:60])
    df = warc.read_warc(spark, str(tmp_path))
    rows = {r.status: r for r in df.collect()}
    assert rows[200].body == b"<p>hi</p>" and rows[200].headers["etag"] == '"x"' and rows[304].ts == rows[200].ts - 1
    later = df.withColumn("ts", F.when(F.col("status") == 304, F.col("ts") + 10).otherwise(F.col("ts")))
    r = warc.resolve(later).first()
    assert r.outcome == "resolved" and r.merged_headers == {"content-type": "text/html", "etag": 'W/"x"', "date": "now"}


# queries and pipeline


def test_pipeline(spark):
    """Every stage against a plain version of its rule."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    stages = [df]
    from strandlake.llm.common import written

    for name, stage in cp.STAGES:
        stages.append(written(stage(spark, stages[-1], sf), f"test-{name.replace(' ', '-')}"))
    for before, after in itertools.pairwise(stages[:-1]):
        assert after.columns == df.columns and after.exceptAll(before).count() == 0
    p = [s.toPandas() for s in stages]
    assert len(p[2]) == len(brute_groups(list(zip(p[1].doc_id, p[1].text, strict=True))))
    comps = dict(brute_components([(int(i), slow_fingerprint(t)) for i, t in zip(p[2].doc_id, p[2].text, strict=True)]))
    assert set(p[3].doc_id) == {i for i, c in comps.items() if i == c}
    items = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
    flat = lambda t: " ".join(decontam.words(t))
    leaks = {i for i, t in zip(p[3].doc_id, p[3].text, strict=True) if any(f" {flat(b)} " in f" {flat(t)} " for b in items.text)}
    gone = set(p[3].doc_id) - set(p[4].doc_id)
    assert leaks <= gone and len(gone) <= len(leaks) + 3
    mix = p[5]
    assert set(mix.doc_id) <= set(p[4].doc_id) and (mix.copies.between(1, 3)).all()
    assert ((mix.groupby("source").taken.sum() - mix.groupby("source").target.first()).abs() <= 1).all()
