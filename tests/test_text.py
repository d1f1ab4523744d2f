"""Helpers on text and packed integers, and allocation of bins."""

import itertools

import pytest
from pyspark.sql import functions as F

from strandlake.functions import text as tx
from strandlake.operators import cn
from strandlake.sources import readers, writers


def test_forms_and_cookies(spark):
    df = spark.createDataFrame([(1, "a=1&b=x%20y&a=2&&c&d=e=f", "s=1; t=%41"), (2, "", ""), (3, None, None), (4, "bad=%zz&ok=1", "x")], "i int, body string, cookie string")
    got = {r.i: (r.f, r.c) for r in df.select("i", tx.form_fields(F.col("body")).alias("f"), tx.cookies(F.col("cookie")).alias("c")).collect()}
    assert got == {1: ({"a": "2", "b": "x y", "c": "", "d": "e=f"}, {"s": "1", "t": "A"}), 2: ({}, {}), 3: (None, None), 4: ({"bad": None, "ok": "1"}, {"x": ""})}
    row = spark.range(1).select(tx.html_unescape(tx.html_escape(F.lit('<a href="x">&amp;</a>'))).alias("back"), tx.html_escape(F.lit("a<b")).alias("e")).first()
    assert row.back == '<a href="x">&amp;</a>' and row.e == "a&lt;b"


def test_packed_integers(spark):
    with pytest.raises(ValueError, match="63"):
        tx.packed([F.lit(1)], [64])
    row = spark.range(1).select(*tx.unpacked(tx.packed([F.lit(5), F.lit(0), F.lit((1 << 40) - 1)], [3, 20, 40]), [3, 20, 40])).first()
    assert tuple(row) == (5, 0, (1 << 40) - 1)


def test_allocation_raises_the_least_count_per_bin():
    for totals in ({0: 100, 1: 50, 2: 10}, {0: 7, 1: 7, 2: 7}, {0: 1000, 1: 1}, {0: 33, 1: 20, 2: 19, 3: 3}):
        for n in range(len(totals), 14):
            got = cn.allocate(totals, n)
            least = lambda x: min(totals[c] / k for c, k in x.items())
            every = (dict(zip(totals, x, strict=True)) for x in itertools.product(range(1, n + 1), repeat=len(totals)) if sum(x) == n)
            assert sum(got.values()) == n and least(got) == max(map(least, every))
    assert sum(cn.allocate({0: 100, 1: 50}, 10, {1: 2.0}).values()) == 10 and cn.allocate({0: 100, 1: 50}, 10, {1: 2.0}) == {0: 5, 1: 5}


def test_finebins_of_any_block(spark, tmp_path):
    counts = spark.createDataFrame([(1, 0, 3), (1, 999, 1), (2, 5, 70000)], "chr int, pos long, count long")
    lengths = spark.createDataFrame([(1, 1000), (2, 6), (3, 4)], "chr int, len long")
    path = f"file://{tmp_path}/fine"
    writers.write_finebins(counts, lengths, path)
    assert {p.name: p.stat().st_size for p in (tmp_path / "fine").iterdir()} == {"1.bin": 4000, "2.bin": 24, "3.bin": 16}
    for block in (1, 7, 1 << 20):
        if block > 1:
            assert sorted(map(tuple, readers.read_finebins(spark, path, block).collect())) == [(1, 0, 3), (1, 999, 1), (2, 5, 70000)]


def test_numbered_lines_of_split_files(spark, tmp_path):
    """Small splits cut a file at odd places; numbers and records stay right, plain or compressed."""
    import gzip

    text = "".join(f"@r{i} x\n{'ACGT' * (i % 5 + 1)}\n+\n{'@III' * (i % 5 + 1)}\n" for i in range(500)) + "@cut\nAC\n"
    (tmp_path / "a.fastq").write_text(text)
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(text.encode()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = readers.read_fastq(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = sorted((i, f"r{i}", "ACGT" * (i % 5 + 1), "@III" * (i % 5 + 1)) for i in range(500))
    for name in ("a.fastq", "b.fastq.gz"):
        assert sorted((r.record, r.name, r.seq, r.qual) for r in rows if r.file.endswith(name)) == want
