"""Exact deduplication by stateful streaming, with DataFrame functions only.

1. Every row becomes an *arrival*: digest (SHA-256 of the normalised text), code
   points, stable identifier (doc_id) and content locator (Parquet file and row
   number). Arrivals are appended to a table in the shared folder; texts stay
   where they are.
2. A Structured Streaming aggregation consumes the arrivals. Its state is keyed
   by digest, lives in RocksDB (on disk), has no watermark and so never expires,
   and retains the best arrival so far (its points, id and locator) and a count.
   Partial aggregation comes before the shuffle, so a group with a third of all
   rows costs one row per task. Each micro-batch writes the keys it changed to a
   folder named by its batch id: a replayed batch overwrites itself.
3. On hits (groups of two or more) the full bytes are checked: the least and the
   greatest text of the group must be the same. Rows that share a digest but not
   the bytes are regrouped by (digest, text).

Edge cases: null text counts as empty; empty texts are one group; the row with
most code points, then the smallest doc_id (null last), then the first locator
stays, so repeated rows leave exactly one; an empty table gives an empty result;
extra columns do no harm.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, only, shared_dir, without_rows, written

#: Digests of groups with copies that are broadcast at most (about 100 bytes each).
BROADCAST_HITS = 100_000
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: don't reserve disk for logs ahead of need
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.metricsEnabled": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
KEEP = "keep struct<points: bigint, order: struct<known: boolean, down: bigint>, file: string, row: bigint, doc_id: bigint>"


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", "")


def digest_of(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _has_locator(docs: DataFrame) -> bool:
    """Whether ``docs`` is a plain scan of Parquet files, so that rows have a file and a row number."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def located(docs: DataFrame) -> DataFrame:
    """``docs`` as (doc_id, text, file, row): a frame that is no plain file scan is written first."""
    docs = only(docs, "doc_id", "text")
    if not _has_locator(docs):
        docs = written(docs, "dedup-source")
    return docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def arrivals(docs: DataFrame, digest=digest_of) -> DataFrame:
    """One row per document: digest, points, doc_id and locator, without the text."""
    return docs.select(
        digest(F.col("text")).alias("digest"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("points"), F.col("doc_id").cast("long").alias("doc_id"), "file", "row"
    )


def _candidate() -> Column:
    # the largest struct wins: most points, then a known and small id, then the locator; ids are bit-flipped so that small ones are large
    return F.struct(
        "points", F.struct(F.col("doc_id").isNotNull().alias("known"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("down")).alias("order"), "file", "row", "doc_id"
    )


def keep_state(spark: SparkSession, path: str, schema, files_per_batch: int | None = None, base: str | None = None) -> DataFrame:
    """Run the stream over the arrivals at ``path``; the state per digest: keep, group_size.

    The stream's state and log are below ``base``: with the same folder it goes
    on where it stopped, and reads new files only.
    """
    base = base or shared_dir(spark, "dedup")
    out, log = f"{base}/keys", f"{base}/log"
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    try:
        for k, v in ROCKS.items():
            spark.conf.set(k, v)
        reader = spark.readStream.schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        state = reader.parquet(path).groupBy("digest").agg(F.max(_candidate()).alias("keep"), F.count("*").alias("group_size"))
        query = (
            state.writeStream.outputMode("update").option("checkpointLocation", log).trigger(availableNow=True)
            .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    latest = spark.read.schema(f"digest string, {KEEP}, group_size bigint, batch int").parquet(out)
    # keep and group_size only ever grow, so their maxima are the last state
    return latest.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size"))


def checked(docs: DataFrame, hits: DataFrame, rows: int, digest=digest_of) -> DataFrame:
    """Digests of hit groups (digest, group_size) whose rows are not all of the same bytes; ``rows``: how many rows there are.

    All bytes of a group are equal if its least and its greatest text are; both
    are found with partial aggregation, so a task that holds a thousand copies
    passes on one or two texts. While they are few (``BROADCAST_HITS``) the hit
    digests are broadcast, so texts of unique documents are never shuffled. With
    more of them, groups above rows / BROADCAST_HITS rows are broadcast, of which
    there are fewer than BROADCAST_HITS by that very bound, and only groups up
    to that size meet by a shuffle: no task gets a hot group's texts.
    """
    every = docs.select(digest(F.col("text")).alias("digest"), normalised(F.col("text")).alias("bytes"))

    def unequal(members: DataFrame) -> DataFrame:
        return members.groupBy("digest").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most")).filter("least != most").select("digest")

    if hits.count() <= BROADCAST_HITS:
        return unequal(every.join(F.broadcast(hits.select("digest")), "digest", "left_semi"))
    hot = F.col("group_size") > max(2, rows // BROADCAST_HITS)
    large, small = hits.filter(hot).select("digest"), hits.filter(~hot).select("digest")
    return unequal(every.join(F.broadcast(large), "digest", "left_semi")).union(unequal(every.join(small.hint("shuffle_merge"), "digest", "left_semi")))


def dedup(docs: DataFrame, digest=digest_of, files_per_batch: int | None = None, state: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, file, row, digest, keep_id, group_size, kept.

    With a folder ``state`` (in shared storage) the stream's state outlives the
    call: a later call with other rows goes on from there, and judges them
    against all rows of the calls before, whose Parquet files must still stand
    where they stood. Rows of earlier calls aren't returned again.
    """
    spark = docs.sparkSession
    docs = located(docs)
    base = state.rstrip("/") if state else shared_dir(spark, "dedup")
    path = f"{base}/arrivals"
    part = f"call-{uuid.uuid4().hex[:12]}"
    arrivals(docs, digest).write.parquet(f"{path}/{part}")
    seen = spark.read.parquet(f"{path}/{part}")
    keys = written(keep_state(spark, f"{path}/*", seen.schema, files_per_batch, base), "dedup-keys")
    if state:  # groups that this call's rows are in
        keys = written(keys.join(seen.select("digest").distinct(), "digest", "left_semi"), "dedup-keys")
    hits = keys.filter("group_size > 1")
    if state:  # the texts of earlier rows are read where the locators say
        before = _earlier(spark, path, part, hits)
        docs = docs if before is None else docs.unionByName(before)
    total = keys.agg(F.sum("group_size")).first()[0] or 0
    broken = written(checked(docs, hits, total, digest), "dedup-unequal")
    rows = _decide(seen, keys)
    if broken.limit(1).count() == 0:
        return rows
    # different bytes under one digest: only those groups are decided anew, by the text itself
    again = docs.select(digest(F.col("text")).alias("digest"), normalised(F.col("text")).alias("bytes"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("points"), "doc_id", "file", "row").join(broken, "digest", "left_semi")
    groups = again.groupBy("digest", "bytes").agg(F.max(_candidate()).alias("keep"), F.count("*").alias("group_size"))
    decided = _decide(again, groups, "digest", "bytes").join(seen.select("file", "row"), ["file", "row"], "left_semi").select(*rows.columns)
    return rows.join(broken, "digest", "left_anti").unionByName(decided)


def _earlier(spark: SparkSession, path: str, part: str, hits: DataFrame) -> DataFrame | None:
    """(doc_id, text, file, row) of the rows of earlier calls whose digest was hit; None if there is none."""
    old = spark.read.option("recursiveFileLookup", "true").parquet(path).filter(~F.contains(F.col("_metadata.file_path"), F.lit(f"/{part}/")))
    places = written(old.join(hits.select("digest"), "digest", "left_semi").select("file", "row"), "dedup-earlier")
    files = [r[0] for r in places.select("file").distinct().collect()]  # names of input files
    if not files:
        return None
    rows = spark.read.parquet(*files).select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.join(places, ["file", "row"], "left_semi").select("doc_id", "text", "file", "row")


def _decide(rows: DataFrame, state: DataFrame, *keys: str) -> DataFrame:
    kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    return rows.join(state, list(keys) or ["digest"]).select("doc_id", "file", "row", "digest", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """All columns of the rows that stay."""
    if not _has_locator(docs):
        docs = written(docs, "dedup-source")
    return without_rows(docs, dedup(docs).filter("NOT kept").select("file", "row"))
