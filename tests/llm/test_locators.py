"""Rows with null and repeated ids leave one by one, not by their id."""

from strandlake.llm import decontam, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], SCHEMA)


def test_near_copies_with_null_and_repeated_ids(spark):
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcde")
    # a copy of document 1 has no id; 7 stands for two texts; the copies of d have no ids at all; the copies of e share one
    df = rows(spark, [(1, a), (None, a), (None, b), (7, c), (7, a), (None, d), (None, d), (None, d), (9, e), (9, e)])
    got = simhash.distinct_documents(df)
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(1, a), (0, b), (7, c), (0, d), (9, e)])
    assert got.columns == df.columns


def test_contaminated_rows_at_any_benchmark_size(spark):
    item = " ".join(f"w{k}" for k in range(20))
    other = " ".join(f"v{k}" for k in range(20))
    df = rows(spark, [(None, f"x {item} y"), (None, "clean"), (3, item), (3, "other clean text"), (4, other), (None, None), (5, "z")])
    bench = spark.createDataFrame([(1, item), (2, other), (3, " ".join(f"u{k}" for k in range(40)))], "item_id long, text string")
    want = [(0, ""), (0, "clean"), (3, "other clean text"), (5, "z")]
    assert len(decontam._blocks(spark, bench, 20)) > 1
    for chars in (10**6, 20):
        got = decontam.clean_documents(df, bench, block_chars=chars)
        assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == want
        assert got.columns == df.columns
