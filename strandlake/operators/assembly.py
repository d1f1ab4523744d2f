"""Assembly: the De Bruijn graph of k-mers, its unbranched paths, and counts of inexact occurrences.

Edges are distinct k-mers, from their first to their last k - 1 letters. Paths are
found by pointer doubling: a round joins the edge table with itself on the
predecessor, so a path of n edges takes log2(n) rounds, each written to the
shared folder. No part of the graph reaches the driver but two counts a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import hamming
from ..shared import stored
from .sequence import placed_kmers


def edges(sequences: DataFrame, k: int, least: int = 1) -> DataFrame:
    """(kmer, n): k-mers of ``seq`` that occur at least ``least`` times."""
    rows = placed_kmers(sequences.select(F.lit(0).alias("all"), "seq"), "all", k)
    return rows.groupBy("kmer").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _nodes(graph: DataFrame) -> DataFrame:
    """(node, n_in, n_out) of all ends of edges."""
    k = F.length("kmer")
    ends = graph.select(F.explode(F.array(F.struct(F.expr("left(kmer, length(kmer) - 1)").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.substring("kmer", F.lit(2), k).alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.select("e.*").groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def unitigs(graph: DataFrame) -> DataFrame:
    """(unitig, n_edges, mean_count, starts, ends): maximal paths without a branch.

    ``starts`` is the number of edges into the first node, ``ends`` that out of
    the last one: 0 is a dead end. A cycle without a branch starts at its least
    k-mer. An empty graph has no path.
    """
    graph = stored(graph.select("kmer", "n", F.expr("left(kmer, length(kmer) - 1)").alias("a"), F.expr("substring(kmer, 2)").alias("b")), "graph")
    nodes = stored(_nodes(graph), "graph-nodes")
    inner = nodes.filter("n_in = 1 AND n_out = 1").select("node")
    # the edge before, through a node that is on one path only
    before = graph.select(F.col("b").alias("node"), F.col("kmer").alias("p")).join(inner, "node")
    state = graph.select("kmer", F.col("a").alias("node")).join(before, "node", "left").select("kmer", F.coalesce("p", "kmer").alias("p"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("d"), F.least("kmer", F.coalesce("p", "kmer")).alias("low"), F.col("p").isNull().alias("done"))
    state = stored(state, "paths")
    total, reach = state.count(), 1
    while (left := state.filter("NOT done").count()) and reach < 2 * total:
        up = state.select(F.col("kmer").alias("p"), F.col("p").alias("p2"), F.col("d").alias("d2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        # one step further, or there already
        state = stored(state.join(up, "p").select("kmer", F.col("p2").alias("p"), F.when(F.col("done"), F.col("d")).otherwise(F.col("d") + F.col("d2")).alias("d"), F.least("low", "low2").alias("low"), (F.col("done") | F.col("done2")).alias("done")), "paths")
        reach *= 2
    if left:  # cycles: cut before the least k-mer, and gone through once more
        ring = stored(state.filter("NOT done").select("kmer", "low"), "cycles")
        links = ring.join(graph.select("kmer", F.col("a").alias("node")), "kmer").join(before, "node").select("kmer", "low", "p")
        cut = F.col("kmer") == F.col("low")
        ring = stored(links.select("kmer", F.when(cut, F.col("kmer")).otherwise(F.col("p")).alias("p"), F.when(cut, 0).otherwise(1).cast("long").alias("d"), cut.alias("done")), "cycles")
        while ring.filter("NOT done").count():
            up = ring.select(F.col("kmer").alias("p"), F.col("p").alias("p2"), F.col("d").alias("d2"), F.col("done").alias("done2"))
            ring = stored(ring.join(up, "p").select("kmer", F.col("p2").alias("p"), F.when(F.col("done"), F.col("d")).otherwise(F.col("d") + F.col("d2")).alias("d"), (F.col("done") | F.col("done2")).alias("done")), "cycles")
        state = state.filter("done").select("kmer", "p", "d").union(ring.select("kmer", "p", "d"))
    rows = state.select("kmer", "p", "d").join(graph.select("kmer", "n"), "kmer")
    paths = rows.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("d", F.expr("right(kmer, 1)").alias("x"), "kmer"))).alias("e"), F.count("*").alias("n_edges"), F.avg("n").alias("mean_count"))
    last = F.element_at("e", -1)["kmer"]
    out = paths.select(F.concat("p", F.array_join(F.transform(F.slice("e", 2, F.size("e")), lambda x: x["x"]), "")).alias("unitig"), "n_edges", "mean_count", F.expr("left(p, length(p) - 1)").alias("first"), F.substring(last, F.lit(2), F.length(last)).alias("last"))
    at = lambda name, c, kind: nodes.select(F.col("node").alias(name), F.col(kind).alias(c))
    return out.join(at("first", "starts", "n_in"), "first").join(at("last", "ends", "n_out"), "last").select("unitig", "n_edges", "mean_count", "starts", "ends")


def without_tips(graph: DataFrame, longest: int, most: float) -> DataFrame:
    """The graph without tips: paths of up to ``longest`` edges with a dead end at one side, a branch at the other, and a mean count of at most ``most``."""
    k = graph.select(F.length("kmer").alias("k")).limit(1).first()
    if k is None:
        return graph
    tips = unitigs(graph).filter((F.col("n_edges") <= longest) & (F.col("mean_count") <= most) & ((F.col("starts") == 0) != (F.col("ends") == 0)))
    gone = placed_kmers(tips.select(F.lit(0).alias("all"), F.col("unitig").alias("seq")), "all", k["k"]).select("kmer")
    return graph.join(gone, "kmer", "left_anti")


def mismatch_counts(queries: DataFrame, reference: DataFrame, most: int) -> DataFrame:
    """(kmer, mismatches, n): how many of the reference's k-mers lie at each distance of up to ``most`` letters from a query.

    ``queries`` has distinct ``kmer``, ``reference`` distinct ``kmer`` and ``n``,
    all of one length. Of most + 1 pieces one is equal, so candidates meet by an
    equi-join on a piece; a pair counts at the first piece that it shares.
    """

    def pieces(df: DataFrame, *columns: str) -> DataFrame:
        size = lambda i: F.floor(F.length("kmer") * i / (most + 1)).cast("int")
        cut = F.array(*[F.struct(F.lit(i).alias("i"), F.substring("kmer", size(i) + 1, size(i + 1) - size(i)).alias("piece")) for i in range(most + 1)])
        return df.select("kmer", *columns, cut.alias("cut")).select("kmer", *columns, "cut", F.inline("cut"))

    q, r = pieces(queries), pieces(reference, "n").select(F.col("kmer").alias("other"), "n", F.col("cut").alias("cut2"), "i", "piece")
    met = q.join(r, ["i", "piece"])
    first = ~F.exists(F.zip_with("cut", "cut2", lambda x, y: (x["piece"] == y["piece"]) & (x["i"] < F.col("i"))), lambda same: same)
    near = met.filter(first).withColumn("mismatches", hamming(F.col("kmer"), F.col("other"))).filter(F.col("mismatches") <= most)
    return near.groupBy("kmer", "mismatches").agg(F.sum("n").alias("n"))
