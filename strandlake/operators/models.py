"""Models that Spark has no operator for: smoothing, segmentation, hidden Markov models, neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored

#: Numbers of a tile of differences between queries and points.
KNN_TILE = 1 << 24


def lowess_values(x: np.ndarray, y: np.ndarray, frac: float = 0.1, iterations: int = 5, delta: float = 0.01) -> np.ndarray:
    """Cleveland's robust locally weighted regression of y on sorted x.

    Fits are made at *anchors*, each the furthest point within ``delta`` of the
    one before, all at once in pieces of bounded size; equal x share a fit, and
    the points between two anchors are interpolated.
    """
    n = len(x)
    if n < 2:
        return y.astype(float).copy()
    size = max(2, min(n, int(frac * n)))
    anchors = _anchors(x, delta)
    left = _neighbourhoods(x, x[anchors], size)
    robust, fit = np.ones(n), np.zeros(n)
    for _ in range(iterations + 1):
        at = np.concatenate([_local_fits(x, y, robust, anchors[s : s + FITS], left[s : s + FITS], size) for s in range(0, len(anchors), FITS)])
        fit = np.interp(x, x[anchors], at)
        rest = np.abs(y - fit)
        middle = np.sort(rest)[[n // 2, max(0, n // 2 - 1)]]
        scale = 3 * middle.sum()
        if scale <= 1e-12 * max(1.0, np.abs(y).mean()):
            break
        u = rest / scale
        robust = np.select([u <= 0.001, u <= 0.999], [1.0, (1 - u**2) ** 2], 0.0)
    return fit


#: Anchors that are fitted at once.
FITS = 512


def _anchors(x: np.ndarray, delta: float) -> np.ndarray:
    """Positions of distinct x: from each the furthest within ``delta``, at least the next."""
    values, first = np.unique(x, return_index=True)
    out, k = [0], 0
    while k < len(values) - 1:
        k = max(k + 1, int(np.searchsorted(values, values[k] + delta, "right")) - 1)
        out.append(k)
    return first[np.array(out)]


def _neighbourhoods(x: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Start of the ``size`` points nearest to each place: where the point behind the window is further than its first one."""
    low, high = np.zeros(len(at), int), np.full(len(at), len(x) - size)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        nearer = at - x[middle] > x[np.minimum(middle + size, len(x) - 1)] - at
        low, high = np.where(open_ & nearer, middle + 1, low), np.where(open_ & ~nearer, middle, high)
    return low


def _local_fits(x: np.ndarray, y: np.ndarray, robust: np.ndarray, anchors: np.ndarray, left: np.ndarray, size: int) -> np.ndarray:
    """Weighted linear fits at some anchors, over the points that are no further than the furthest of each window."""
    here = x[anchors]
    h = np.maximum(here - x[left], x[left + size - 1] - here)
    stop = np.maximum(left + size, np.searchsorted(x, here + 0.999 * h, "right"))  # ties at the edge belong to it
    cells = left[:, None] + np.arange(int((stop - left).max()))
    inside = cells < stop[:, None]
    cells = np.where(inside, cells, 0)
    d = np.abs(x[cells] - here[:, None])
    u = d / np.where(h > 0, h, 1.0)[:, None]
    w = np.select([u <= 0.001, u <= 0.999], [1.0, (1 - u**3) ** 3], 0.0) * robust[cells] * inside
    total = w.sum(1)
    known = total > 0
    w = w / np.where(known, total, 1.0)[:, None]
    mean = (w * x[cells]).sum(1)
    off = x[cells] - mean[:, None]
    spread = (w * off**2).sum(1)
    slope = (h > 0) & (np.sqrt(spread) > 0.001 * (x[-1] - x[0]))
    tilt = np.where(slope, (here - mean) / np.where(slope, spread, 1.0), 0.0)
    w = w * (1 + tilt[:, None] * off)
    return np.where(known, (w * y[cells]).sum(1), y[anchors])


def lowess(df: DataFrame, keys: list[str], order: str, x: str, y: str, frac: float = 0.1, iterations: int = 5, delta: float = 0.01) -> DataFrame:
    """``smooth`` for every row; a group is one profile (its bins, some tens of thousands)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values([x, order], kind="stable")
        return p.assign(smooth=lowess_values(p[x].to_numpy(float), p[y].to_numpy(float), frac, iterations, delta))

    columns = list(dict.fromkeys([*keys, order, x, y]))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns) + ", smooth double"
    return df.select(*columns).groupBy(*keys).applyInPandas(lambda p: run(p), schema)


def _best_arc(y: np.ndarray, block: int = 64) -> tuple[float, int, int]:
    """Largest |t| over circular arcs [i, j), from the cumulative sums; of equal ones the first.

    Starts and ends are taken in blocks. Between two blocks |s[j] - s[i]| is at most
    the spread of their sums, and size * (1 - size / n) at least that of the
    shortest or longest arc; block pairs whose bound lies below an arc that
    is already known are left out, so none that is better is missed.
    """
    n = len(y)
    s = np.r_[0.0, np.cumsum(y - y.mean())]
    if n > 4 * block:
        return _pruned_arc(s, n, block)
    best = (0.0, 0, 0)
    for i in range(n):
        k = np.arange(i + 1, n + 1)
        size = k - i
        ok = size < n
        t = np.abs(s[k] - s[i]) / np.sqrt(np.where(ok, size * (1 - size / n), 1.0))
        t = np.where(ok, t, 0)
        j = int(np.argmax(t))
        if t[j] > best[0]:
            best = (float(t[j]), i, i + 1 + j)
    return best


def _pruned_arc(s: np.ndarray, n: int, block: int) -> tuple[float, int, int]:
    starts = np.arange(0, n + 1, block)
    stops = np.r_[starts[1:], n + 1]
    low, high = np.minimum.reduceat(s, starts), np.maximum.reduceat(s, starts)
    a, b = np.triu_indices(len(starts))
    shortest = np.maximum(1, starts[b] - stops[a] + 1)
    longest = np.minimum(n - 1, stops[b] - 1 - starts[a])
    spread = np.maximum(high[b] - low[a], high[a] - low[b])
    least = np.minimum(shortest * (1 - shortest / n), longest * (1 - longest / n))
    # a margin for rounding: bounds may only be too large
    bound = spread / np.sqrt(np.maximum(least, 1e-300)) * (1 + 1e-9)
    best = (0.0, 0, 0)
    for k in np.argsort(-bound, kind="stable"):
        if bound[k] < best[0]:
            break
        i, j = np.arange(starts[a[k]], stops[a[k]]), np.arange(starts[b[k]], stops[b[k]])
        size = j[None, :] - i[:, None]
        ok = (size > 0) & (size < n)
        t = np.where(ok, np.abs(s[j][None, :] - s[i][:, None]) / np.sqrt(np.where(ok, size * (1 - size / n), 1.0)), 0.0)
        at = int(np.argmax(t))
        x, y = divmod(at, len(j))
        found = (float(t[x, y]), int(i[x]), int(j[y]))
        if found[0] > best[0] or found[0] == best[0] and found[1:] < best[1:]:
            best = found
    return best


def cbs_cuts(y: np.ndarray, alpha: float = 0.01, permutations: int = 200, least: int = 2, seed: int = 25) -> list[int]:
    """Change points by circular binary segmentation with permutation tests."""
    rng = np.random.default_rng(seed)
    cuts, todo = [], [(0, len(y))]
    while todo:
        a, b = todo.pop()
        part = y[a:b]
        if b - a < 2 * least or np.ptp(part) == 0:
            continue
        t, i, j = _best_arc(part)
        above = 0
        for k in range(permutations):
            above += _best_arc(rng.permutation(part))[0] >= t
            if above > alpha * permutations:
                break
        if above > alpha * permutations:
            continue
        ends = sorted({a + i, a + j} - {a, b})
        ends = [e for e in ends if e - a >= least and b - e >= least]
        if ends:
            cuts += ends
            edges = [a, *ends, b]
            todo += list(zip(edges[:-1], edges[1:], strict=True))
    return sorted(set(cuts))


def segment(df: DataFrame, keys: list[str], order: str, value: str, alpha: float = 0.01) -> DataFrame:
    """``segment`` and ``segment_mean`` for every row, per profile and chromosome."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(order, kind="stable")
        y = p[value].to_numpy(float)
        number = np.zeros(len(y), int)
        for c in cbs_cuts(y, alpha):
            number[c:] += 1
        return p.assign(segment=number, segment_mean=pd.Series(y, index=p.index).groupby(number).transform("mean"))

    columns = list(dict.fromkeys([*keys, order, value]))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns) + ", segment int, segment_mean double"
    return df.select(*columns).groupBy(*keys).applyInPandas(lambda p: run(p), schema)


class Hmm:
    """Discrete hidden Markov model in log space."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        with np.errstate(divide="ignore"):
            self.start, self.move, self.emit = np.log(start), np.log(move), np.log(emit)

    def forward(self, seen: np.ndarray) -> np.ndarray:
        out = [self.start + self.emit[:, seen[0]]]
        for o in seen[1:]:
            out.append(np.logaddexp.reduce(out[-1][:, None] + self.move, axis=0) + self.emit[:, o])
        return np.array(out)

    def backward(self, seen: np.ndarray) -> np.ndarray:
        out = [np.zeros(len(self.start))]
        for o in seen[:0:-1]:
            out.append(np.logaddexp.reduce(self.move + self.emit[:, o] + out[-1], axis=1))
        return np.array(out[::-1])

    def posterior(self, seen: np.ndarray) -> np.ndarray:
        p = self.forward(seen) + self.backward(seen)
        return np.exp(p - np.logaddexp.reduce(p, axis=1, keepdims=True))

    def fitted(self, seen: np.ndarray, rounds: int = 10) -> Hmm:
        """Baum-Welch re-estimation."""
        model = self
        for _ in range(rounds):
            a, b = model.forward(seen), model.backward(seen)
            total = np.logaddexp.reduce(a[-1])
            g = np.exp(a + b - total)
            x = np.exp(a[:-1, :, None] + model.move + (model.emit[:, seen[1:]].T + b[1:])[:, None, :] - total).sum(0)
            emit = np.array([g[seen == o].sum(0) for o in range(model.emit.shape[1])]).T
            model = Hmm(g[0], x / x.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
        return model


def hmm_states(df: DataFrame, keys: list[str], order: str, value: str, start, move, emit, rounds: int = 0) -> DataFrame:
    """Most likely state (posterior) of every row, per sequence, after ``rounds`` of re-estimation."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(order, kind="stable")
        seen = p[value].to_numpy(int)
        model = Hmm(np.array(start), np.array(move), np.array(emit))
        post = (model.fitted(seen, rounds) if rounds else model).posterior(seen)
        return p.assign(state=post.argmax(1), probability=post.max(1))

    columns = list(dict.fromkeys([*keys, order, value]))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns) + ", state int, probability double"
    return df.select(*columns).groupBy(*keys).applyInPandas(lambda p: run(p), schema)


def nearest_neighbours(queries: DataFrame, points: DataFrame, k: int, block_rows: int = 4096) -> DataFrame:
    """The k nearest points (Euclidean, ties: smaller id) of every query: (query_id, point_id, distance, rank).

    ``queries`` and ``points`` have id and vector. Queries are a stated set and
    taken in blocks of about ``block_rows``, one after the other: the driver and
    a task hold one block at a time, whatever their number. Each task compares
    the block with its points, a bounded tile at a time and by one formula, and
    keeps k per query; a top-k per query merges the tasks.
    """
    q = queries.select("id", "vector")
    blocks = max(1, -(-q.count() // block_rows))
    both = None
    for b in range(blocks):
        rows = q.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()  # bounded: one block
        ids, vectors = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float).reshape(len(rows), -1)

        def run(batches: Iterator[pd.DataFrame], ids=ids, vectors=vectors) -> Iterator[pd.DataFrame]:
            best_d, best_i = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for p in batches:
                if not len(p) or not len(ids):
                    continue
                x, at = np.array(p["vector"].tolist(), float), p["id"].to_numpy(np.int64)
                step = max(1, KNN_TILE // (x.shape[1] * len(ids)))
                for s in range(0, len(x), step):
                    d = np.sqrt(((vectors[:, None, :] - x[None, s : s + step, :]) ** 2).sum(2))
                    all_d, all_i = np.concatenate([best_d, d], 1), np.concatenate([best_i, np.broadcast_to(at[s : s + step], d.shape)], 1)
                    order = np.lexsort((all_i, all_d), axis=1)[:, :k]
                    best_d, best_i = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
            keep = np.isfinite(best_d)
            yield pd.DataFrame({"query_id": np.broadcast_to(ids[:, None], keep.shape)[keep], "point_id": best_i[keep], "distance": best_d[keep]})

        part = points.select("id", "vector").mapInPandas(run, "query_id long, point_id long, distance double")
        if blocks > 1:  # done before the next block is fetched
            part = stored(part, "knn-block")
        both = part if both is None else both.union(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "point_id"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k)


#: Places of a task of the density, on either side, and of a leaf of its trees. Cells further out than FAR share one.
DENSITY_PLACES, DENSITY_LEAF, FAR = 250_000, 128, float(1 << 40)


def _boxes(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """A tree of halves along the wider side: an order of the points, and (from, to, least x, greatest x, least y, greatest y, children) by node."""
    order = np.arange(len(x))
    nodes: list[tuple] = [()]
    todo = [(0, 0, len(x))]
    while todo:
        k, a, b = todo.pop()
        mine = order[a:b]
        box = float(x[mine].min()), float(x[mine].max()), float(y[mine].min()), float(y[mine].max())
        child = 0
        if b - a > DENSITY_LEAF:
            along, half = (x if box[1] - box[0] >= box[3] - box[2] else y), (b - a) // 2
            order[a:b] = mine[np.argpartition(along[mine], half)]
            child = len(nodes)
            nodes += [(), ()]
            todo += [(child, a, a + half), (child + 1, a + half, b)]
        nodes[k] = a, b, *box, child
    return order, nodes


def near_counts(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, n: np.ndarray, radius: float) -> np.ndarray:
    """For every (x, y), the sum of n over the (px, py) within ``radius``.

    Boxes that lie wholly inside or outside of the radius are decided at once,
    by the same formula as single points (which rounding keeps in order); only
    leaves across its edge are compared point by point.
    """
    out, most = np.zeros(len(x), np.int64), radius * radius
    if not len(x) or not len(px):
        return out
    (order, left), (p_order, right) = _boxes(x, y), _boxes(px, py)
    x, y, px, py, n = x[order], y[order], px[p_order], py[p_order], n[p_order]
    total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    todo = [(0, 0)]
    while todo:
        k, m = todo.pop()
        a, b, x0, x1, y0, y1, child = left[k]
        pa, pb, px0, px1, py0, py1, p_child = right[m]
        dx, dy = max(0.0, x0 - px1, px0 - x1), max(0.0, y0 - py1, py0 - y1)
        if dx * dx + dy * dy > most:
            continue
        dx, dy = max(x1 - px0, px1 - x0), max(y1 - py0, py1 - y0)
        if dx * dx + dy * dy <= most:
            out[a:b] += total[pb] - total[pa]
        elif not child and not p_child:
            dx, dy = x[a:b, None] - px[None, pa:pb], y[a:b, None] - py[None, pa:pb]
            out[a:b] += np.where(dx * dx + dy * dy <= most, n[pa:pb], 0).sum(1)
        elif child and (not p_child or b - a >= pb - pa):
            todo += [(child, m), (child + 1, m)]
        else:
            todo += [(k, p_child), (k, p_child + 1)]
    back = np.empty_like(out)
    back[order] = out
    return back


def grid_density(df: DataFrame, x: str, y: str, cell: float, radius: float) -> DataFrame:
    """Different rows within ``radius`` (at most one cell) of each, itself included; rows without a finite place are near none and left out.

    Rows at one place count as one place with a number. Each cell meets the
    places of the cells around it, in parts of bounded size, and counts by
    :func:`near_counts`; no pair of rows is made.
    """
    if radius > cell:
        raise ValueError("radius must not exceed the cell size")
    width = cell * (1 + 1e-9)  # a difference that rounds to the radius never skips a cell
    rows = df.distinct()
    finite = lambda c: F.abs(F.col(c)) < F.lit(float("inf"))
    at = lambda c: F.floor(F.greatest(F.least(F.col(c) / width, F.lit(FAR)), F.lit(-FAR)))
    places = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(finite("x") & finite("y")).groupBy("x", "y").agg(F.count("*").alias("n"))
    places = stored(places.withColumn("cx", at("x")).withColumn("cy", at("y")), "density-places")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    around = lambda d: d.withColumn("s", steps).withColumn("cx", F.col("cx") + F.col("s.i")).withColumn("cy", F.col("cy") + F.col("s.j")).drop("s")
    parts = lambda c: F.ceil(F.sum(c) / DENSITY_PLACES)
    cells = places.groupBy("cx", "cy").agg(F.count("*").alias("k"))
    tasks = cells.groupBy("cx", "cy").agg(parts("k").alias("own")).join(around(cells).groupBy("cx", "cy").agg(parts("k").alias("near")), ["cx", "cy"])
    part = lambda c: F.pmod(F.xxhash64("x", "y"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    mine = places.join(tasks, ["cx", "cy"]).select("cx", "cy", part("own").alias("p"), every("near").alias("q"), "x", "y", F.lit(0).cast("long").alias("n"))
    theirs = around(places).join(tasks, ["cx", "cy"]).select("cx", "cy", every("own").alias("p"), part("near").alias("q"), "x", "y", "n")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        a, b = p[p["n"] == 0], p[p["n"] > 0]
        return pd.DataFrame({"x": a["x"], "y": a["y"], "density": near_counts(*(d[c].to_numpy() for d, c in ((a, "x"), (a, "y"), (b, "x"), (b, "y"), (b, "n"))), radius)})

    counts = mine.unionByName(theirs).groupBy("cx", "cy", "p", "q").applyInPandas(run, "x double, y double, density long")
    counts = counts.groupBy(F.col("x").alias("__x"), F.col("y").alias("__y")).agg(F.sum("density").alias("density"))
    return rows.join(counts, (F.col(x).cast("double") == F.col("__x")) & (F.col(y).cast("double") == F.col("__y"))).select(*df.columns, "density")
