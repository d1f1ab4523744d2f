"""Seeded generators: positions, sequences, families, events. Every value is a hash of its row, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key only: the first 52 bits of a digest of their text."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(1 << 52)


def random_positions(spark: SparkSession, n: int, chromosomes: DataFrame, seed: int) -> DataFrame:
    """Uniform positions over the genome: abspos, chr, pos."""
    from ..functions.coords import to_chrpos

    size = chromosomes.agg(F.sum("len").alias("size"))
    rows = spark.range(n).crossJoin(F.broadcast(size))  # one row
    return to_chrpos(rows.select("id", F.floor(uniform(seed, F.col("id")) * F.col("size")).alias("abspos")), chromosomes)


def random_sequences(spark: SparkSession, n: int, length: int, seed: int) -> DataFrame:
    cells = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substring(F.lit("ACGT"), (F.floor(uniform(seed, F.col("id"), i) * 4) + 1).cast("int"), F.lit(1)))
    return spark.range(n).select("id", F.array_join(cells, "").alias("seq"))


def sample_rows(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """``n`` draws with replacement: row numbers by hash of the order, met by an equi-join."""
    from pyspark.sql import Window

    numbered = df.withColumn("__row", F.row_number().over(Window.orderBy(*key)) - 1)
    total = df.agg(F.count("*").alias("__n"))
    draws = df.sparkSession.range(n).crossJoin(F.broadcast(total)).select(F.col("id").alias("draw"), F.floor(uniform(seed, F.col("id")) * F.col("__n")).cast("int").alias("__row"))  # one row
    return draws.join(numbered, "__row").drop("__row")


def families(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Families of mother, father, proband and sibling: sample, family, member, relation, sex."""
    rows = spark.range(n).select(F.col("id").cast("int").alias("family"), F.explode(F.array(*[F.lit(m) for m in ("mother", "father", "proband", "sibling")])).alias("member"))
    sex = F.when(F.col("member") == "mother", "XX").when(F.col("member") == "father", "XY").when(uniform(seed, F.col("family"), F.col("member")) < 0.5, "XX").otherwise("XY")
    relation = F.when(F.col("member").isin("mother", "father"), "parent").otherwise("child")
    return rows.select(F.concat_ws("-", "family", "member").alias("sample"), "family", "member", relation.alias("relation"), sex.alias("sex"))


def simulate_events(spark: SparkSession, n: int, chromosomes: DataFrame, longest: int, seed: int) -> DataFrame:
    """Known deletions, insertions, inversions and translocations at random places."""
    at = random_positions(spark, n, chromosomes, seed).select("id", "chr", F.col("pos").alias("start"))
    kinds = F.array(*[F.lit(k) for k in ("deletion", "insertion", "inversion", "translocation")])
    size = (F.floor(uniform(seed + 1, F.col("id")) * longest) + 1).cast("long")
    return at.select("id", "chr", "start", (F.col("start") + size).alias("stop"), F.get(kinds, F.floor(uniform(seed + 2, F.col("id")) * 4).cast("int")).alias("type"))
