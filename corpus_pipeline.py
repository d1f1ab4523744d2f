"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``; the last adds what the mix decided.

Edge cases, for every stage: rows with nulls in any column go through it, a null
text counts as empty; rows are kept or dropped by where they stand, so null and
repeated ids do no harm; extra columns come through whatever their names (a
column that is named like one that the mix adds comes back as ``input_`` and its
name); texts of any length are read whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontam, exact_dedup, mixing, simhash, toxicity
from strandlake.llm.common import fold, read_table, written


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the weakly supervised classifier scores 0.5 or more; held-out labels stay unseen. Empty texts stay."""
    labels = read_table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    return toxicity.clean_documents(docs, toxicity.fit(docs, labels))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the longest, then first, of documents that are equal but for white space; all texts without words are one."""
    return exact_dedup.distinct_documents(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by SimHash: that of the least known id, then of the first place."""
    return simhash.distinct_documents(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, reordered or not, each by its own text."""
    return decontam.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often (``copies``) and the source's budget; a null source is a source."""
    return mixing.mix(docs).filter("copies > 0")


STAGES = [
    ("toxicity", remove_toxic),
    ("exact dedup", remove_copies),
    ("SimHash near-dedup", remove_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("source mix", mix_sources),
]

#: A trained classifier and a bit-wise fingerprint are beyond SQL; tests hold the rows against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
