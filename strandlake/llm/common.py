"""Helpers that the training-data operators share.

Nothing here is specific to one operator: where intermediate tables go, how a
word is defined, and how the fixed folds of the queries are computed.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship

#: The white-space characters that separate words.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` decides, then the folder that the context was given.
    Only where both are unset and Spark runs in one process (tests) a temporary
    folder is made and set for the session; on a cluster its executors could not
    see each other's files, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/strandlake/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage.

    A lost executor costs a re-read of the files, not a recomputation.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id's decimal text, mod k; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Project by exact name, quoted, so that dots in names do no harm."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of a Parquet scan but those at ``gone`` (file, row); equal rows are told apart by where they stand."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return whole.join(gone.select("file", "row"), ["file", "row"], "left_anti").select(*[F.col("kept")[c].alias(c) for c in docs.columns])
