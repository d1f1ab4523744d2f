"""Every stage of the pipeline on rows that are null, empty, long, equal or oddly named, and on no rows."""

from collections import Counter

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from strandlake.llm import mixing
from strandlake.llm.common import written

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ("file", "row", "__file", "__row", "__at_file", "__gone", "__in", "kept", "size", "taken", "fp", "digest", "score", "a.b", "copies", "KEEP")


def odd_rows(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two  three four five six"), (None, None), (2, None), (3, ""), (4, " \n"), (5, "word " * 60_000), (6, f"before {item} after"),
            (None, "a text of its own that nobody else has"), (None, "and another one without any id at all"), (7, "seven is said twice"), (7, "but of two different texts")]
    df = spark.createDataFrame([(i, t, None if i == 3 else "en", None if i in (2, 7) else "s", None) for i, t in rows], SCHEMA)
    return df.withColumns({c: F.lit(c) for c in ODD})


def key(r):
    return (r.doc_id, r.text)


def test_stages_on_odd_rows(spark):
    df = written(odd_rows(spark), "odd")
    docs, counts = df, []
    for name, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "odd")
        assert docs.columns == df.columns
        counts.append(Counter(map(key, docs.collect())))
    toxic, exact, near, clean = counts
    assert toxic == Counter(map(key, df.collect()))
    # one of the three that are equal but for white space: the longest text; one of the four without words
    assert Counter(i for i, _ in exact) == Counter({None: 3, 4: 1, 5: 1, 6: 1, 7: 2}) and all(n == 1 for n in exact.values())
    assert near == exact
    assert clean == Counter({k: n for k, n in near.items() if k[0] != 6})
    mixed = cp.STAGES[-1][1](spark, docs, SF)
    assert mixed.columns == [f"input_{c}" if c.lower() in mixing.RESULT else c for c in df.columns] + list(mixing.RESULT)
    rows = mixed.collect()
    assert rows and all(1 <= r.copies <= 3 and r.taken == r["size"] * r.copies for r in rows)
    assert {r["a.b"] for r in rows} == {"a.b"} and {r["input_size"] for r in rows} == {"size"}


@pytest.mark.parametrize("k", range(len(cp.STAGES)))
def test_stages_on_no_rows(spark, k):
    none = written(odd_rows(spark).limit(0), "none")
    assert cp.STAGES[k][1](spark, none, SF).count() == 0
