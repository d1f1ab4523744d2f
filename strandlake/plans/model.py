"""How the driver tables stand for the domain's tables.

Every mapping is a plain projection, given once as a DataFrame and once as SQL
for the oracle, so that both sides start from the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import ship
from ..functions.stats import upper_median
from ..operators import bridges as br
from ..operators import store as st
from ..shared import stored


def micros(c: str) -> Column:
    """Microseconds since 1970 of a time without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))


class Tables:
    """The driver tables of one folder, and the domain tables that they stand for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def chromosomes(self) -> DataFrame:
        return self.region.filter("r_regionkey < 3").select(F.col("r_regionkey").alias("chr"), (2000 * (F.col("r_regionkey") + 1)).cast("long").alias("len"))

    @cached_property
    def samples(self) -> DataFrame:
        s = F.col("id").cast("int")
        member = F.element_at(F.array(*[F.lit(m) for m in ("mother", "father", "proband", "sibling")]), s % 4 + 1)
        family = (F.floor(s / 4)).cast("int")
        sex = F.when(s % 4 == 0, "XX").when(s % 4 == 1, "XY").otherwise(F.when(family % 2 == 0, "XX").otherwise("XY"))
        return self.spark.range(20).select(s.alias("sample"), family.alias("family"), member.alias("member"), F.when(s % 4 < 2, "parent").otherwise("child").alias("relation"), sex.alias("sex"))

    @cached_property
    def reads(self) -> DataFrame:
        """The matches of each order's two reads as an array: one shuffle on the order."""
        m = self.lineitem.select(
            F.col("l_orderkey").alias("pair_id"),
            F.struct(
                "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_suppkey") % 3).cast("int").alias("chr"), ((F.col("l_partkey") % 12) * 100).cast("long").alias("pos"),
                (20 + F.col("l_quantity").cast("int") % 3).cast("int").alias("len"), (F.col("l_returnflag") == "R").alias("flipped"), (F.col("l_linestatus") == "F").alias("read_2"),
            ).alias("m"),
        )
        return st.laid_out(m.groupBy("pair_id").agg(F.sort_array(F.collect_list("m")).alias("raw")))

    @cached_property
    def mums(self) -> DataFrame:
        return st.flat(self.reads)

    @cached_property
    def placed(self) -> DataFrame:
        """Matches by place only, for what needs no order in the read: a projection."""
        return self.lineitem.select(
            F.col("l_orderkey").alias("pair_id"), (F.col("l_suppkey") % 3).cast("int").alias("chr"), ((F.col("l_partkey") % 12) * 100).cast("long").alias("pos"), (20 + F.col("l_quantity").cast("int") % 3).cast("int").alias("len"),
            (F.col("l_linestatus") == "F").alias("read_2"),
        )

    @cached_property
    def store(self) -> DataFrame:
        """The match store: one row per order with its matches, read lengths, bad reads by order priority, and the sample."""
        first = F.substring("o_orderpriority", 1, 1)
        o = self.orders.select(F.col("o_orderkey").alias("pair_id"), (F.col("o_custkey") % 20).cast("int").alias("sample"), (first == "1").alias("bad1"), (first == "2").alias("bad2"))
        return st.read_lengths(o.join(self.reads, "pair_id"))

    @cached_property
    def pairs(self) -> DataFrame:
        """One row per order: read lengths, bad reads, and the sample."""
        return self.store.select("pair_id", "sample", "bad1", "bad2", "len1", "len2")

    @cached_property
    def marked_store(self) -> DataFrame:
        return st.mark_duplicates(self.store)

    @cached_property
    def marked_pairs(self) -> DataFrame:
        return self.marked_store.drop("matches")

    @cached_property
    def observed_bridges(self) -> DataFrame:
        return st.bridges(self.marked_store, "sample")

    @cached_property
    def sample_bridges(self) -> DataFrame:
        return br.sample_bridges(self.observed_bridges)

    @cached_property
    def genes(self) -> DataFrame:
        """Parts as genes of one to two exons on three chromosomes."""
        s, k = F.col("p_partkey") * 50, F.col("p_size").cast("long") * 10
        exon = lambda a, b: F.struct((s + a).alias("start"), (s + b).alias("stop"))
        return self.part.select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_partkey") % 3).cast("int").alias("chr"), s.alias("start"), (s + k).alias("stop"), F.array(exon(F.lit(0), F.floor(k / 4)), exon(F.floor(k / 2), k)).alias("exons"))

    @cached_property
    def gaps(self) -> DataFrame:
        s = F.col("s_suppkey") * 997
        return self.supplier.select((F.col("s_suppkey") % 3).cast("int").alias("chr"), s.alias("start"), (s + 40 + F.col("s_nationkey")).cast("long").alias("stop"), F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("type"))

    @cached_property
    def repeats(self) -> DataFrame:
        s = F.col("p_partkey") * 37
        return self.part.select((F.col("p_partkey") % 3).cast("int").alias("chr"), s.alias("start"), (s + 2 * F.col("p_size")).cast("long").alias("stop"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("motif"))

    @cached_property
    def points(self) -> DataFrame:
        """Distinct places of order lines."""
        return self.lineitem.select((F.col("l_suppkey") % 3).cast("int").alias("chr"), (F.col("l_partkey") * 49 + F.col("l_suppkey")).alias("pos")).distinct()

    @cached_property
    def intervals(self) -> DataFrame:
        """Per user, the time from one event to the next, in minutes since 2024."""
        w = Window.partitionBy("user_id").orderBy("ts")
        minute = F.floor((micros("ts") - F.lit(1704067200000000)) / 60_000_000)
        e = self.events.select("user_id", "ts", "event_type", minute.alias("start")).withColumn("stop", F.lead("start").over(w))
        return e.filter("stop > start").select((F.col("user_id") % 3).cast("int").alias("chr"), "start", "stop", F.col("event_type").alias("type"), "user_id")

    @cached_property
    def profile(self) -> DataFrame:
        """Order lines per sample and day as a copy-number profile: count, ratio to the upper median, rounded as segment ratio."""
        o = self.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 20).cast("int").alias("sample"))
        bin_ = F.floor(micros("l_shipdate") / 86_400_000_000 / 30).cast("int")
        c = self.lineitem.select("l_orderkey", bin_.alias("bin")).join(o, "l_orderkey").groupBy("sample", "bin").agg(F.count("*").alias("count"))
        c = stored(c, "profile")  # samples by bins: every median of it reads this table

        m = upper_median(c, ["sample"], "count")
        ratio = F.col("count") / F.col("median")
        p = c.join(F.broadcast(m), "sample").withColumn("ratio", ratio).withColumn("seg_ratio", F.floor(F.col("ratio") * 4) / 4)  # one row per sample
        region = F.when(F.col("bin") % 10 == 8, "X").when(F.col("bin") % 10 == 9, "Y").otherwise("auto")
        return p.select("sample", F.floor(F.col("bin") / 12).cast("int").alias("chr"), "bin", region.alias("region"), "count", "median", "ratio", "seg_ratio")


def rounded(x: Column | str, n: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, n) + F.lit(0.0)


#: SQL of the same mappings. Each piece is a list of common table expressions.
MUMS = """
m0 AS (SELECT l_orderkey AS pair_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(trunc(l_quantity) AS INTEGER) % 3, l_returnflag = 'R', l_linestatus = 'F') - 1 AS INTEGER) AS ord, CAST(l_suppkey % 3 AS INTEGER) AS chr,
  CAST((l_partkey % 12) * 100 AS BIGINT) AS pos, CAST(20 + CAST(trunc(l_quantity) AS INTEGER) % 3 AS INTEGER) AS len, l_returnflag = 'R' AS flipped, l_linestatus = 'F' AS read_2 FROM lineitem),
m1 AS (SELECT *, CAST(coalesce(sum(len + 1) OVER (PARTITION BY pair_id, read_2 ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS off FROM m0),
mums AS (SELECT *, CAST(max(off + len) OVER (PARTITION BY pair_id, read_2) AS INTEGER) AS read_len, ord = max(ord) OVER (PARTITION BY pair_id, read_2) AS last_hit FROM m1)"""
PAIRS = MUMS + """,
pairs AS (SELECT o_orderkey AS pair_id, CAST(o_custkey % 20 AS INTEGER) AS sample, substr(o_orderpriority, 1, 1) = '1' AS bad1, substr(o_orderpriority, 1, 1) = '2' AS bad2, len1, len2 FROM orders JOIN (
  SELECT pair_id AS pid, coalesce(max(read_len) FILTER (NOT read_2), 0) AS len1, coalesce(max(read_len) FILTER (read_2), 0) AS len2 FROM mums GROUP BY 1) ON o_orderkey = pid)"""
READPOS = "CASE WHEN flipped THEN pos - read_len + off + len ELSE pos - off END"
DUPES = PAIRS + f""",
firsts AS (SELECT pair_id, read_2, chr, {READPOS} AS readpos FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, read_2 ORDER BY ord) AS k FROM mums) WHERE k = 1),
marked AS (SELECT p.*, (a.chr IS NOT NULL OR b.chr IS NOT NULL) AND row_number() OVER (PARTITION BY sample, len1, len2, a.chr, a.readpos, b.chr, b.readpos ORDER BY bad1, bad2, p.pair_id) > 1 AS dupe
  FROM pairs p LEFT JOIN firsts a ON p.pair_id = a.pair_id AND NOT a.read_2 LEFT JOIN firsts b ON p.pair_id = b.pair_id AND b.read_2)"""
SUPPORT = DUPES + f""",
rp AS (SELECT *, {READPOS} AS readpos FROM mums),
around AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY pair_id, read_2, chr, flipped, readpos ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  coalesce(sum(len) OVER (PARTITION BY pair_id, read_2, chr, flipped, readpos ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS after FROM rp),
support AS (SELECT *, len + CASE WHEN flipped THEN after ELSE before END AS low_s, len + CASE WHEN flipped THEN before ELSE after END AS high_s FROM around)"""
BRIDGES = SUPPORT + """,
usable AS (SELECT s.* FROM support s JOIN marked m USING (pair_id) WHERE NOT m.dupe AND NOT CASE WHEN read_2 THEN bad2 ELSE bad1 END),
ends AS (SELECT a.pair_id, a.chr AS ca, CASE WHEN a.flipped THEN a.pos ELSE a.pos + a.len - 1 END AS pa, NOT a.flipped AS ha, CASE WHEN a.flipped THEN a.high_s ELSE a.low_s END AS sa,
  b.chr AS cb, CASE WHEN b.flipped THEN b.pos + b.len - 1 ELSE b.pos END AS pb, b.flipped AS hb, CASE WHEN b.flipped THEN b.low_s ELSE b.high_s END AS sb, CAST(b.off - (a.off + a.len - 1) AS INTEGER) AS off
  FROM usable a JOIN usable b USING (pair_id, read_2) WHERE a.ord < b.ord),
turned AS (SELECT *, CASE WHEN ca <> cb THEN ca > cb WHEN pa <> pb THEN pa < pb ELSE ha OR NOT hb END AS keep FROM ends WHERE sa >= 20 AND sb >= 20),
observed AS (SELECT t.pair_id, sample, CASE WHEN keep THEN ca ELSE cb END AS chr1, CASE WHEN keep THEN pa ELSE pb END AS pos1, CASE WHEN keep THEN ha ELSE hb END AS high1, CASE WHEN keep THEN cb ELSE ca END AS chr2,
  CASE WHEN keep THEN pb ELSE pa END AS pos2, CASE WHEN keep THEN hb ELSE ha END AS high2, off AS "offset", CAST(max(CASE WHEN keep THEN sa ELSE sb END) AS INTEGER) AS anchor1_len, CAST(max(CASE WHEN keep THEN sb ELSE sa END) AS INTEGER) AS anchor2_len
  FROM turned t JOIN pairs USING (pair_id) GROUP BY ALL),
bridges AS (SELECT sample, chr1, pos1, high1, chr2, pos2, high2, "offset", CAST(least(count(*), 65535) AS INTEGER) AS bridge_count, max(anchor1_len) AS anchor1_len, max(anchor2_len) AS anchor2_len FROM observed GROUP BY ALL)"""
SIG = 'chr1, pos1, high1, chr2, pos2, high2, "offset"'
INV = '((CASE WHEN high1 THEN 1 ELSE -1 END) * pos1 + (CASE WHEN high2 THEN 1 ELSE -1 END) * pos2 + "offset")'
SAMPLES = """
samples AS (SELECT CAST(i AS INTEGER) AS sample, CAST(i // 4 AS INTEGER) AS family, ['mother', 'father', 'proband', 'sibling'][i % 4 + 1] AS member, CASE WHEN i % 4 < 2 THEN 'parent' ELSE 'child' END AS relation,
  CASE WHEN i % 4 = 0 THEN 'XX' WHEN i % 4 = 1 THEN 'XY' WHEN (i // 4) % 2 = 0 THEN 'XX' ELSE 'XY' END AS sex FROM range(20) t(i))"""
COHORT = BRIDGES + "," + SAMPLES
POPULATION = COHORT + f""",
population AS (SELECT {SIG}, count(*) AS n_people, CAST(sum(bridge_count) AS BIGINT) AS n_bridges, list_sort(list(bridge_count))[count(*) // 2 + 1] AS median_bridges, max(bridge_count) AS max_bridges
  FROM bridges JOIN samples USING (sample) WHERE relation = 'parent' AND {INV} <> 0 GROUP BY ALL HAVING count(*) <> sum(bridge_count))"""
GENES = """
genes AS (SELECT 'g' || p_partkey AS name, CAST(p_partkey % 3 AS INTEGER) AS chr, p_partkey * 50 AS start, p_partkey * 50 + p_size * 10 AS stop,
  [{'a': p_partkey * 50, 'b': p_partkey * 50 + CAST(floor(p_size * 10 / 4.0) AS BIGINT)}, {'a': p_partkey * 50 + p_size * 10 // 2, 'b': p_partkey * 50 + p_size * 10}] AS exons FROM part)"""
GAPS = "gaps AS (SELECT CAST(s_suppkey % 3 AS INTEGER) AS chr, s_suppkey * 997 AS start, s_suppkey * 997 + 40 + s_nationkey AS stop, 't' || s_nationkey AS type FROM supplier)"
REPEATS = "repeats AS (SELECT CAST(p_partkey % 3 AS INTEGER) AS chr, p_partkey * 37 AS start, p_partkey * 37 + 2 * p_size AS stop, 'm' || p_partkey AS motif FROM part)"
POINTS = "points AS (SELECT DISTINCT CAST(l_suppkey % 3 AS INTEGER) AS chr, l_partkey * 49 + l_suppkey AS pos FROM lineitem)"
INTERVALS = """
e0 AS (SELECT user_id, ts, event_type, CAST((epoch_us(ts) - 1704067200000000) // 60000000 AS BIGINT) AS start FROM events),
intervals AS (SELECT CAST(user_id % 3 AS INTEGER) AS chr, start, stop, event_type AS type, user_id FROM (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY ts) AS stop FROM e0) WHERE stop > start)"""
PROFILE = """
c0 AS (SELECT CAST(o_custkey % 20 AS INTEGER) AS sample, CAST(floor(epoch_us(l_shipdate) / 86400000000.0 / 30) AS INTEGER) AS bin, count(*) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
c1 AS (SELECT sample, list_sort(list(count))[count(*) // 2 + 1] AS median FROM c0 GROUP BY 1),
profile AS (SELECT sample, CAST(floor(bin / 12.0) AS INTEGER) AS chr, bin, CASE WHEN bin % 10 = 8 THEN 'X' WHEN bin % 10 = 9 THEN 'Y' ELSE 'auto' END AS region, count, median, CAST(count AS DOUBLE) / median AS ratio,
  floor(CAST(count AS DOUBLE) / median * 4) / 4 AS seg_ratio FROM c0 JOIN c1 USING (sample))"""
