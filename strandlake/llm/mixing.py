"""Mixing sources to target weights by subset-sum budget fitting.

Every source has a word budget (its target). Whole passes over a source cover
most of it; the rest is met in two steps. A seeded hash threshold takes
documents in bulk up to a little below the budget, and a bounded-knapsack
dynamic programme over the *histogram of exact token lengths* of the documents
not yet taken fills what remains. The programme says how many documents of each
length to take; the seeded order says which.

What reaches the driver: one row per source (mixing weights are set per source,
so sources are configuration-sized), ``BUCKETS`` sums per refined source and
level, and the length histogram up to twice the open budget. None of them grows
with the number of documents.

Rows that repeat the same source, id and text are decided one by one like any
other: the n-th of them has an order key of its own. How many of them the mix
takes depends on the data only; which ones is settled by where they stand, and
as they are equal it makes no difference. Their numbers come from partial counts
over slices, so a group of a third of all rows is never numbered in one task.

Edge cases: null text has size 0; size-0 documents are taken 0 words; a null
source is a source of its own and sorts last; an empty table gives an empty
result; extra columns are carried by :func:`mix`, and one that is named like a
result column comes back as ``input_`` and its name.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, only, written
from .exact_dedup import _has_locator as has_locator

#: The cycle of source weights, and the most passes over a source.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SEED = 20260701
BITS, LEVEL_BITS = 60, 10
#: Words left open for the dynamic programme, at least; a bulk bucket is refined while it is larger than MAX_OPEN.
MARGIN, MAX_OPEN = 4096, 100_000
#: A dimension of at most so many rows is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Rows of a repeated unit that are opened or numbered in one task.
SLICE = 1 << 16


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, cap=MAX_REPEATS) -> dict[str | None, float]:
    """Words per source: 100 % of all words by weight, capped, excess reshared."""
    order = sorted((s for s, _ in sizes if s is not None)) + [s for s, _ in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    size = dict(sizes)
    left, active, out = float(sum(size.values())), list(order), {}
    while active:
        unit = left / sum(weight[s] for s in active)
        over = [s for s in active if unit * weight[s] > cap * size[s]]
        if not over:
            return out | {s: unit * weight[s] for s in active}
        for s in over:
            out[s] = float(cap * size[s])
            left -= out[s]
        active = [s for s in active if s not in out]
    return out


def fit_lengths(histogram: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """Bounded knapsack: how many of each length come nearest to ``budget``.

    Exact over sums up to twice the budget; of two equally near sums the
    smaller one wins. ``histogram`` holds (length, how many there are).
    """
    if budget <= 0:
        return {}
    top = 2 * budget
    reach = np.zeros(top + 1, bool)
    reach[0] = True
    parent = np.full(top + 1, -1, np.int64)
    parts: list[tuple[int, int]] = []
    for length, n in sorted(histogram, reverse=True):
        n, step = min(n, top // length if length else 0), 1
        while n > 0 and not reach[budget]:
            m = min(step, n)
            n, step, w = n - m, step * 2, length * m
            if w > top:
                continue
            new = reach[:-w] & ~reach[w:]
            parent[w:][new] = len(parts)
            reach[w:] |= new
            parts.append((length, m))
    sums = np.flatnonzero(reach)
    best = int(sums[np.lexsort((sums, np.abs(sums - budget)))[0]])
    taken: dict[int, int] = {}
    while best:
        length, m = parts[parent[best]]
        taken[length] = taken.get(length, 0) + m
        best -= length * m
    return taken


def _small(dim: DataFrame, n: int) -> DataFrame:
    return F.broadcast(dim) if n <= BROADCAST_ROWS else dim


def plan(pieces: DataFrame, weights=WEIGHTS, cap=MAX_REPEATS) -> tuple[list[tuple], DataFrame | None, int]:
    """Per source (size, target, whole passes, bulk threshold), and the pieces picked beside the bulk.

    ``pieces``: (source, doc_id, size, u, k, h), one per row; rows of equal (source, doc_id, u) are alike and numbered by k.
    """
    spark = pieces.sparkSession
    # sources are configuration-sized: one row each comes to the driver
    sizes = [(r[0], int(r[1])) for r in pieces.groupBy("source").agg(F.sum("size").alias("words")).collect()]
    goal = targets(sizes, weights, cap)
    state = {}
    for s, size in sizes:
        passes = min(cap, int(goal[s] // size)) if size else 0
        state[s] = {"size": size, "passes": passes, "rest": max(0, round(goal[s] - passes * size)) if size and passes < cap else 0, "low": 0, "cum": 0}
    shift, todo = BITS, [s for s, x in state.items() if x["rest"] > MARGIN]
    while todo and shift > 0:
        # sums per hash bucket inside each source's open range: refine the bucket in which the budget runs out
        shift -= LEVEL_BITS
        ranges = spark.createDataFrame([(s, state[s]["low"]) for s in todo], "k_source string, low long")
        sums = (
            pieces.join(_small(ranges, len(todo)), F.col("source").eqNullSafe(F.col("k_source")))
            .filter((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + F.lit(1 << (shift + LEVEL_BITS))))
            .groupBy("source", F.shiftright(F.col("h") - F.col("low"), shift).alias("bucket"))
            .agg(F.sum("size").alias("words"))
        )
        got: dict = {s: np.zeros(1 << LEVEL_BITS, np.int64) for s in todo}
        for s, b, words in sums.toLocalIterator():
            got[s][b] = words
        again = []
        for s in todo:
            x, cum = state[s], np.cumsum(got[s])
            stop = int(np.searchsorted(cum, x["rest"] - MARGIN - x["cum"], side="right"))
            x["low"] += stop << shift
            x["cum"] += int(cum[stop - 1]) if stop else 0
            if stop < len(cum) and got[s][stop] > MAX_OPEN:
                again.append(s)
        todo = again
    open_ = [(s, x["low"], 2 * (x["rest"] - x["cum"])) for s, x in state.items() if x["rest"] > x["cum"]]
    rows = [(s, x["size"], float(goal[s]), x["passes"], x["low"]) for s, x in state.items()]
    if not open_:
        return rows, None, 0
    ranges = spark.createDataFrame(open_, "k_source string, low long, most long")
    pool = (
        pieces.withColumnRenamed("size", "words")
        .join(_small(ranges, len(open_)), F.col("source").eqNullSafe(F.col("k_source")))
        .filter((F.col("h") >= F.col("low")) & (F.col("words") > 0) & (F.col("words") <= F.col("most")))
        .select("source", "doc_id", "words", "u", "k", "h")
    )
    lengths: dict = {s: [] for s, _, _ in open_}
    for s, words, n in pool.groupBy("source", "words").count().toLocalIterator():
        lengths[s].append((words, n))
    picks = [(s, length, c) for s, _, twice in open_ for length, c in sorted(fit_lengths(lengths[s], twice // 2).items())]
    if not picks:
        return rows, None, 0
    counts = spark.createDataFrame(picks, "p_source string, p_words long, p_count int")
    rank = F.row_number().over(_window())
    chosen = (
        pool.join(_small(counts, len(picks)), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("words") == F.col("p_words")))
        .withColumn("rank", rank)
        # the literal bound lets Spark keep only the first rows of each group before it shuffles
        .filter(F.col("rank") <= max(c for _, _, c in picks))
        .filter(F.col("rank") <= F.col("p_count"))
        .select(F.col("source").alias("p_source"), F.col("doc_id").alias("p_doc_id"), F.col("u").alias("p_u"), F.col("k").alias("p_k"))
    )
    return rows, chosen, sum(c for _, _, c in picks)


def _window():
    return Window.partitionBy("source", "words").orderBy("h", "doc_id", "k")


def _pieces(units: DataFrame, seed: int) -> DataFrame:
    """One row per row that the units stand for: (source, doc_id, size, u, k, h); u is the unit's key, k its number there, h its own order key."""
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "u", "k"), 64 - BITS)
    one = units.filter("n = 1").select("source", "doc_id", "size", F.col("h").alias("u"), F.lit(0).cast("long").alias("k"), "h")
    # a large unit is opened in two steps, so that its rows come from many tasks
    some = units.filter("n > 1").select("source", "doc_id", "size", F.col("h").alias("u"), "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLICE).cast("long"))).alias("at"))
    some = some.repartition("source", "doc_id", "u", "at").select("source", "doc_id", "size", "u", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + SLICE, F.col("n")) - 1)).alias("k"))
    return one.unionByName(some.withColumn("h", key))


def _numbered(rows: DataFrame, repeated: DataFrame, n: int) -> DataFrame:
    """(file, row, k) of the rows of repeated units: k counts the rows of a unit from 0."""
    unit = ["source", "doc_id", "u"]
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in unit])
    own = rows.withColumnRenamed("h", "u").join(_small(repeated.select(*[F.col(c).alias(f"r_{c}") for c in unit], F.col("n").alias("r_n")), n), same)
    # slices by place: their sizes are summed before, and each is numbered by itself
    own = own.withColumn("slice", F.pmod(F.xxhash64("file", "row"), F.ceil(F.col("r_n") / SLICE))).select(*unit, "slice", "file", "row")
    sizes = own.groupBy(*unit, "slice").agg(F.count("*").alias("m"))
    before = Window.partitionBy(*unit).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(c).alias(f"s_{c}") for c in [*unit, "slice"]], F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"))
    inside = own.withColumn("k", F.row_number().over(Window.partitionBy(*unit, "slice").orderBy("file", "row")))
    met = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in [*unit, "slice"]])
    return inside.join(sizes, met).select(*unit, "file", "row", (F.col("first") + F.col("k") - 1).alias("k"))


def _decided(docs: DataFrame, rows: DataFrame, weights, cap, seed: int) -> DataFrame:
    """``docs`` (with __source, __doc_id, __size, __h, __file and __row) and source_size, target and copies.

    ``rows`` has the same rows without texts: source, doc_id, size, h, file, row.
    """
    spark = docs.sparkSession
    units = written(rows.groupBy("source", "doc_id", "size", "h").agg(F.count("*").alias("n")), "mix-units")
    repeated = units.filter("n > 1").withColumnRenamed("h", "u")
    n_repeated = repeated.count()
    pieces = units.select("source", "doc_id", "size", F.col("h").alias("u"), F.lit(0).cast("long").alias("k"), "h")
    if n_repeated:
        pieces = written(_pieces(units, seed), "mix-pieces")
    per_source, chosen, n = plan(pieces, weights, cap)
    dim = spark.createDataFrame(per_source, "k_source string, source_size long, target double, passes int, low long")
    out = docs.join(_small(dim, len(per_source)), F.col("__source").eqNullSafe(F.col("k_source")), "left")
    extra = F.when(F.col("__h") < F.col("low"), 1).otherwise(0)
    if chosen is not None:
        chosen = written(chosen, "mix-picks")
        out = out.join(
            _small(chosen.filter("p_k = 0").withColumn("picked", F.lit(1)), n),
            F.col("__source").eqNullSafe(F.col("p_source")) & F.col("__doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("__h") == F.col("p_u")),
            "left",
        )
        extra += F.coalesce(F.col("picked"), F.lit(0))
    if n_repeated:
        # how many rows of each repeated unit get one more copy; then the rows that do
        unit = ["source", "doc_id", "u"]
        bulk = pieces.join(repeated.select(*[F.col(c).alias(f"r_{c}") for c in unit]), reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in unit]))
        bulk = bulk.join(_small(dim, len(per_source)), F.col("source").eqNullSafe(F.col("k_source"))).filter("h < low").select(*unit)
        if chosen is not None:
            bulk = bulk.union(chosen.select("p_source", "p_doc_id", "p_u"))
        more = bulk.groupBy(*unit).agg(F.count("*").alias("more"))
        more = more.select(*[F.col(c).alias(f"m_{c}") for c in unit], "more")
        numbered = _numbered(rows, repeated, n_repeated).join(more, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in unit]), "left")
        places = written(numbered.select(F.col("file").alias("n_file"), F.col("row").alias("n_row"), (F.col("k") < F.coalesce("more", F.lit(0))).cast("int").alias("by_place")), "mix-places")
        out = out.join(_small(places, places.count()), (F.col("__file") == F.col("n_file")) & (F.col("__row") == F.col("n_row")), "left")
        extra = F.coalesce(F.col("by_place"), extra)
    return out.withColumn("copies", F.least(F.lit(cap), F.coalesce(F.col("passes"), F.lit(0)) + extra).cast("int"))


RESULT = ("size", "source_size", "target", "copies", "taken")
HIDDEN = ("__doc_id", "__source", "__size", "__h", "__file", "__row")


def _sized(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """A Parquet scan of ``docs`` with the columns HIDDEN, and its narrow copy in the shared folder."""
    if not has_locator(docs):
        docs = written(docs, "mix-source")
    text = F.col("text")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__in"), F.col("doc_id").alias("__doc_id"), F.col("source").alias("__source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("__size"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", text), 64 - BITS).alias("__h"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"),
    )
    return keyed, written(keyed.select(*[F.col(c).alias(c[2:]) for c in HIDDEN]), "mix-sizes")


def mix(docs: DataFrame, weights=WEIGHTS, cap=MAX_REPEATS, seed=SEED) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken, one row each."""
    keyed, rows = _sized(docs, seed)
    out = _decided(keyed, rows, weights, cap, seed)
    name = lambda c: f"input_{c}" if c.lower() in RESULT else c
    return out.select(*[F.col("__in")[c].alias(name(c)) for c in docs.columns], F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("__size") * F.col("copies")).alias("taken"))


def mixed_sizes(docs: DataFrame, weights=WEIGHTS, cap=MAX_REPEATS, seed=SEED) -> DataFrame:
    """As :func:`mix`, without texts: doc_id, source, size, source_size, target, copies, taken."""
    _, rows = _sized(only(docs, "doc_id", "source", "text"), seed)
    return _decided(rows.select(*[F.col(c[2:]).alias(c) for c in HIDDEN]), rows, weights, cap, seed).select(
        F.col("__doc_id").alias("doc_id"), F.col("__source").alias("source"), F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("__size") * F.col("copies")).alias("taken")
    )
