"""SimHash near-duplicates by tiled exact comparison.

Fingerprints of equal value are one row from the start, so exact copies cost
nothing. Distinct fingerprints meet in tiles; a tile pair is compared in full
with numpy exclusive-or and bit counts, and skipped where the population counts
of its rows differ by more than the radius (two fingerprints at distance d have
population counts at most d apart).

Which fingerprints share a tile: all that agree on ``blocks - radius`` of
``blocks`` bit blocks. Two fingerprints within the radius differ in at most
``radius`` blocks, so every pair meets in some tile and none is lost, while the
work grows with n times the tile size instead of n squared. A key that holds
more rows than one tile is cut by population count (and by hash beyond that)
into several tiles, and its tile pairs are separate tasks.

A task emits a spanning forest of the links it found, never all pairs; the
forests' components are those of all links.

Edge cases: null and word-less texts have fingerprint zero and link like any
other; fewer words than a shingle form one shingle; repeated rows share a
fingerprint; null ids never become a component id unless all ids of the
component are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, union_all, without_rows, written
from .components import components
from .exact_dedup import _has_locator as has_locator
from .exact_dedup import located

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Rows of a key beyond which its tile pairs become tasks of their own, and rows of a tile inside a task.
TILE, INNER = 8192, 512


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """Signed 64-bit SimHash: bytes.lower and bytes.split touch ASCII letters and ASCII white space only."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n, digest, join = max(1, len(w) - words + 1), xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # long texts in pieces, so that memory stays bounded
        h = np.array([digest(join(w[i : i + words]), SEED) for i in range(at, min(n, at + 65536))], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64-bit) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "fp": np.array([fingerprint(t, words) for t in b["text"]], np.int64)})

    return only(docs, "doc_id", "text").mapInPandas(run, "doc_id long, fp long")


def _forest(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (least index of the component) after linking i with j."""
    while True:
        a, b = labels[i], labels[j]
        if (a == b).all():
            return labels
        least = np.minimum(a, b)
        np.minimum.at(labels, a, least)
        np.minimum.at(labels, b, least)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def link(fp: np.ndarray, pop: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links in one task: (child, root) positions. side: rows of one tile pair meet across sides only; 0 meets all."""
    order = np.argsort(pop, kind="stable")
    fp, pop, side = fp[order], pop[order], side[order]
    labels = np.arange(len(fp))
    for a in range(0, len(fp), INNER):
        for b in range(a, len(fp), INNER):
            if pop[b] - pop[min(a + INNER, len(fp)) - 1] > radius:
                break  # population counts differ beyond the radius, here and in all later tiles
            x, y = fp[a : a + INNER], fp[b : b + INNER]
            near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
            near &= (side[a : a + INNER, None] == 0) | (side[a : a + INNER, None] != side[None, b : b + INNER])
            i, j = np.nonzero(near)
            up = i + a < j + b
            if up.any():
                labels = _forest(labels, i[up] + a, j[up] + b)
    child = np.flatnonzero(labels != np.arange(len(fp)))
    return order[child], order[labels[child]]


def _compare(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def work(p: pd.DataFrame) -> pd.DataFrame:
            fp = p["fp"].to_numpy(np.int64).view(np.uint64)
            pop, side = p["pop"].to_numpy(np.int32), p["side"].to_numpy(np.int8)
            task = p[["k", "v", "pair"]].to_numpy(np.int64)
            cut = np.flatnonzero((task[1:] != task[:-1]).any(1)) + 1
            starts, stops = np.r_[0, cut], np.r_[cut, len(p)]
            ids, links_a, links_b = p["fp"].to_numpy(np.int64), [], []
            size = stops - starts
            two = starts[size == 2]  # the common case, all at once
            two = two[(np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius) & ((side[two] == 0) | (side[two] != side[two + 1]))]
            links_a.append(ids[two])
            links_b.append(ids[two + 1])
            for s, e in zip(starts[size > 2], stops[size > 2], strict=True):
                child, root = link(fp[s:e], pop[s:e], side[s:e], radius)
                links_a.append(ids[s:e][child])
                links_b.append(ids[s:e][root])
            return pd.DataFrame({"a": np.concatenate(links_a), "b": np.concatenate(links_b)})

        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if b.empty:
                continue
            # rows come sorted by task: the last task may go on in the next batch
            last = b[["k", "v", "pair"]].iloc[-1]
            open_ = ((b["k"] == last["k"]) & (b["v"] == last["v"]) & (b["pair"] == last["pair"])).to_numpy()
            rest, done = b[open_], b[~open_]
            if len(done):
                yield work(done.reset_index(drop=True))
        if rest is not None and len(rest):
            yield work(rest.reset_index(drop=True))

    return run


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Bit blocks, so that a key of ``blocks - radius`` of them expects a small part of a tile."""
    blocks = radius + 1
    while n / 2.0 ** (64 * (blocks - radius) / blocks) > TILE / 64 and blocks < 2 * radius + 2:
        blocks += 1
    return blocks


def links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """(a, b): a graph on the distinct ``fp`` values whose components are those of all links within ``radius``."""
    blocks = blocks or blocks_for(fps.count(), radius)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keyed = fps.select("fp", F.bit_count("fp").cast("int").alias("pop"), F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("k", "v"))
    # keys with more rows than a tile: counted per population count, after partial sums
    counts = written(keyed.groupBy("k", "v", "pop").agg(F.count("*").alias("n")).groupBy("k", "v").agg(F.sum("n").alias("n"), F.collect_list(F.struct("pop", "n")).alias("pops")).filter(F.col("n") > 1), "tile-counts")
    big = counts.filter(F.col("n") > tile).select("k", "v", F.explode("pops").alias("x")).select("k", "v", F.col("x.pop").alias("t_pop"), F.ceil(F.col("x.n") / tile).cast("int").alias("subs"))
    plain = keyed.join(counts.filter(F.col("n") <= tile).select("k", "v"), ["k", "v"], "left_semi").select("k", "v", F.lit(0).cast("long").alias("pair"), "fp", "pop", F.lit(0).cast("byte").alias("side"))
    parts = [plain]
    if big.limit(1).count():
        tiles = written(big.select("k", "v", "t_pop", "subs", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub")), "tiles")
        x, y = tiles.alias("x"), tiles.alias("y")
        here, there = F.struct("x.t_pop", "x.sub"), F.struct("y.t_pop", "y.sub")
        # tile pairs of one key, those beyond the radius left out; a tile meets itself once
        pairs = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.v") == F.col("y.v")) & (here <= there) & (F.col("y.t_pop") - F.col("x.t_pop") <= radius)).select(
            F.col("x.k").alias("k"), F.col("x.v").alias("v"), F.xxhash64("x.t_pop", "x.sub", "y.t_pop", "y.sub").alias("pair"),
            F.col("x.t_pop").alias("p1"), F.col("x.sub").alias("s1"), F.col("y.t_pop").alias("p2"), F.col("y.sub").alias("s2"),
        )
        same = (F.col("p1") == F.col("p2")) & (F.col("s1") == F.col("s2"))
        roles = pairs.select("k", "v", "pair", F.col("p1").alias("t_pop"), F.col("s1").alias("sub"), F.when(same, 0).otherwise(1).cast("byte").alias("side")).union(
            pairs.filter(~same).select("k", "v", "pair", "p2", "s2", F.lit(2).cast("byte"))
        )
        rows = keyed.join(big.withColumnRenamed("t_pop", "pop"), ["k", "v", "pop"]).withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"))
        parts.append(rows.join(roles.withColumnRenamed("t_pop", "pop"), ["k", "v", "pop", "sub"]).select("k", "v", "pair", "fp", "pop", "side"))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = union_all(parts).repartition(n, "k", "v", "pair").sortWithinPartitions("k", "v", "pair")
    return met.mapInPandas(_compare(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (least doc_id reachable over links)."""
    rows = written(fingerprints(docs, words), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(fps, radius, blocks, tile))
    # only fingerprints with links have a root; the rest are their own component
    linked = fps.join(roots, F.col("fp") == F.col("node")).select("fp", "least", "root")
    least = linked.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("first"))
    found = written(linked.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("l_fp"), "first"), "components")
    ids = fps.join(found, F.col("fp") == F.col("l_fp"), "left").select(F.col("fp").alias("i_fp"), F.coalesce("first", "least").alias("component_id"))
    return rows.join(ids, F.col("fp") == F.col("i_fp")).select("doc_id", "fp", "component_id")


def distinct_documents(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """One row of ``docs`` per component: that of the least known id, then of the first place. Ids may be null or repeat."""
    if not has_locator(docs):
        docs = written(docs, "simhash-source")

    @F.pandas_udf("long")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in text], dtype="int64")

    rows = written(located(docs).select("doc_id", "file", "row", of("text").alias("fp")), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "file", "row")
    fps = written(rows.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    linked = fps.join(components(links(fps, radius, blocks, tile)), F.col("fp") == F.col("node")).select(F.col("fp").alias("l_fp"), "first", "root")
    heads = linked.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("head"))
    heads = written(linked.join(heads, F.col("root") == F.col("r")).select("l_fp", "head"), "components")
    # a fingerprint of one row and no link keeps its row
    kept = fps.join(heads, F.col("fp") == F.col("l_fp"), "left").filter("n > 1 OR l_fp IS NOT NULL").select(F.col("fp").alias("k_fp"), F.coalesce("head", "first").alias("kept"))
    gone = rows.join(kept, F.col("fp") == F.col("k_fp")).filter("file != kept.file OR row != kept.row").select("file", "row")
    return without_rows(docs, gone)
