"""Queries over whole texts against brute force on a small fixture."""

import random

import pytest

from strandlake.plans import registry


def brute_matches(seqs, refs, least):
    out = []
    for q, a in seqs:
        for r, b in refs:
            for i in range(len(a)):
                for j in range(len(b)):
                    if a[i] != b[j] or i and j and a[i - 1] == b[j - 1]:
                        continue
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    if n >= least:
                        out.append((q, r, i, j, n))
    return sorted(out)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("acgt efgh") for _ in range(n))
    passage = word(60)
    items = [(1, passage), (2, word(20) + passage[:40]), (3, word(80))]
    # one long document with a shared passage far behind, one short with a passage, one without, one null
    docs = [(0, word(500) + passage + word(40)), (1, word(30) + items[2][1][:50]), (5, word(50)), (10, word(600) + items[2][1][20:70]), (11, word(90)), (6, None)]
    where = tmp_path_factory.mktemp("whole")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(where / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(where / "benchmark.parquet"))
    return str(where), [(i, t) for i, t in docs if t], items


def test_matches_of_long_documents(spark, tables):
    where, docs, items = tables
    want = brute_matches(docs, items, 30)
    assert any(q == 0 and i >= 400 for q, _, i, _, _ in want)
    got = registry.QUERIES["maximal_matches"](spark, where).collect()
    assert sorted((r.query, r.ref, r.q_start, r.r_start, r.len) for r in got) == want
    # once in the reference: no other match of the query covers it
    texts, refs = dict(docs), [t for _, t in items]
    occurs = lambda s: sum(t.startswith(s, k) for t in refs for k in range(len(t)))
    unique = [m for m in want if occurs(texts[m[0]][m[2] : m[2] + m[4]]) == 1]
    got = registry.QUERIES["unique_matches"](spark, where).collect()
    assert sorted((r.query, r.ref, r.q_start, r.r_start, r.len) for r in got) == unique and unique


def dna(text):
    return "".join(c for c in text.upper() if c in "ACGT")


def test_reads_of_any_length(spark, tables):
    where, docs, _ = tables
    run = lambda name: registry.QUERIES[name](spark, where).collect()
    reads = {i: dna(t) for i, t in docs}
    longest = max(map(len, reads.values()))
    assert longest > 40
    got = {r.cycle: r for r in run("base_counts")}
    assert sorted(got) == list(range(longest))
    for k, r in got.items():
        seen = [s[k] for s in reads.values() if k < len(s)]
        assert (r.depth, r.A, r.C, r.G, r["T"], r.N) == (len(seen), *[seen.count(b) for b in "ACGTN"])

    # documents 0..11 are groups of their own: the consensus is the read
    assert {r.grp: r.consensus for r in run("consensus")} == reads

    got = {r.doc_id: (r.matches, r.testable) for r in run("sequence_similarity") if r.matches is not None and r.doc_id in reads}
    assert got == {i: (sum(a == b for a, b in zip(s, s[2:], strict=False)), max(0, len(s) - 2)) for i, s in reads.items()}

    votes = {}
    for i, s in reads.items():
        for k, b in enumerate(s):
            votes.setdefault((i % 5, i % 7 + k), []).append(b)
    want = {}
    for at, v in votes.items():
        kept = sorted(b for b in set(v) if v.count(b) >= 2 and v.count(b) >= 0.3 * len(v))
        if kept:
            want[at] = (len(v), "/".join(kept))
    assert {(r.chr, r.pos): (r.total, r.call) for r in run("pileup_genotypes")} == want and max(p for _, p in want) > 30

    reads = {i: s + "ACGTN" for i, s in reads.items()}
    assert {r.name: (r.seq, r.qual) for r in run("fastq_scan") if r.seq} == {f"r{i}/1": (s, "I" * len(s)) for i, s in reads.items()}
    assert {r.score: (r.seq, r.cigar) for r in run("sam_round_trip") if r.score in reads} == {i: (s, f"{len(s)}M") for i, s in reads.items()}
    turned = {i: s[::-1].translate(str.maketrans("ACGT", "TGCA")) if i % 3 == 0 else s for i, s in reads.items()}
    want = sorted(f"@q{i // 2}\n{s}\n+\n{'I' * len(s)}" for i, s in turned.items())
    assert sorted(r.value for r in run("sam_to_fastq") if r.value) == want
    want = sorted((i // 2, 77 if i % 2 == 0 else 141, reads[i].replace("N", "A")) for i in (0, 1, 10, 11))
    assert sorted((r.pair_id, r.flag, r.seq) for r in run("fastq_to_sam")) == want
