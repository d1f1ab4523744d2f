"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are word sequences (lower-cased runs of letters,
digits and underscores). A pair is a candidate if it shares a seed: a window of
``MIN_MATCH`` words, found by its Karp-Rabin hash and checked word by word.
Greedy string tiling then marks, longest first, non-overlapping common runs of
at least ``MIN_MATCH`` words, wherever they stand in the document: moving
sentences around changes nothing. The share of the item's words under tiles is
its coverage; from ``THRESHOLD`` on the document is contaminated.

The benchmark is a stated query set against all rows: it is taken in blocks of
about ``BLOCK_CHARS`` characters, one after the other, each held in memory by
the tasks that scan the documents. So the memory is bounded whatever the
benchmark's size; documents are neither shuffled nor collected.

Edge cases: null and empty texts match nothing; an item of fewer than
``MIN_MATCH`` words is found where all its words follow one another in a
document, as one tile; items without words match nothing; equal items are
reported each; repeated rows are reported each; extra columns do no
harm; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, union_all, written

MIN_MATCH, THRESHOLD = 5, 0.8
BLOCK_CHARS = 8_000_000
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, item_id long, coverage double, matched_words long, item_words long, n_tiles int"


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def windows(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``length`` ids, modulo 2^64, by doubling."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done, power = np.zeros(n, np.uint64), 0, ids.astype(np.uint64) + np.uint64(1)
        width, scale = 1, _BASE
        while True:  # power holds the hashes of windows of `width`, scale = base^width
            if length & width:
                out = out * scale + power[done : done + n]
                done += width
            if done == length:
                return out
            power = power[: len(power) - width] * scale + power[width:]
            width, scale = 2 * width, scale * scale


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (doc position, item position, length), longest first, then by position, none overlapping.

    Every round finds the length of the longest common run of free words (a
    common run of n words holds one of every length below n, so halving the
    range finds it, each probe by running hashes) and marks all of that length.
    A round costs O((n + m) log(n + m)) however repetitive the two are, and there
    are at most as many rounds as distinct tile lengths, that is O(sqrt(m)).
    """
    free_d, free_i, out = np.ones(len(doc), bool), np.ones(len(item), bool), []
    longest = min(len(doc), len(item))
    while longest >= least:
        low, high, best = least, longest, None
        while low <= high:
            # the whole first, as a copied item is one run
            size = high if best is None and high == longest else (low + high) // 2
            if met := _common(doc, item, free_d, free_i, size):
                best, low = (size, *met), size + 1
            else:
                high = size - 1
        if best is None:
            break
        size, at_d, h_d, at_i, h_i = best
        places: dict[int, list[int]] = defaultdict(list)
        for p, h in zip(at_i[::-1].tolist(), h_i[::-1].tolist(), strict=True):
            places[h].append(p)  # the first place is the last of its list
        clear_i, end = _runs(free_i, size), -1
        done = []
        for a, h in zip(at_d.tolist(), h_d.tolist(), strict=True):
            if a < end:
                continue
            stack = places[h]
            while stack and not (clear_i[stack[-1]] and free_i[stack[-1]] and free_i[stack[-1] + size - 1]):
                stack.pop()  # covered by now, for good
            if stack and (doc[a : a + size] == item[stack[-1] : stack[-1] + size]).all():
                b = stack.pop()
                free_i[b : b + size] = False
                done.append((a, b, size))
                end = a + size
        for a, _, _ in done:
            free_d[a : a + size] = False
        out += done
        longest = size - 1 if not done else size
        if done and not _common(doc, item, free_d, free_i, size):
            longest = size - 1
    return out


def _common(doc, item, free_d, free_i, size: int) -> tuple | None:
    """Free windows of ``size`` words that both sides have, by their hashes: (doc positions, hashes, item positions, hashes)."""
    at_d, at_i = np.flatnonzero(_runs(free_d, size)), np.flatnonzero(_runs(free_i, size))
    if not len(at_d) or not len(at_i):
        return None
    hd, hi = windows(doc, size)[at_d], windows(item, size)[at_i]
    in_d, in_i = np.isin(hd, hi), np.isin(hi, hd)
    return (at_d[in_d], hd[in_d], at_i[in_i], hi[in_i]) if in_d.any() else None


def _runs(free: np.ndarray, size: int) -> np.ndarray:
    """Whether the window of ``size`` that starts here is free throughout."""
    total = np.r_[0, np.cumsum(free)]
    return total[size:] - total[:-size] == size


class Index:
    """Seeds of one block of the benchmark."""

    def __init__(self, items: list[tuple[int, str | None]], least: int, threshold: float):
        self.least, self.threshold = least, threshold
        self.vocabulary: dict[str, int] = {}
        self.items = [(i, np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(t)], np.int64)) for i, t in items]
        #: Of items of fewer words than a match: hash of all words by their number, with the items.
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        keys, which, where = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, (_, ids) in enumerate(self.items):
            if 0 < len(ids) < least:
                self.short[len(ids)][int(windows(ids, len(ids))[0])].append(n)
            h = windows(ids, least)
            keys.append(h)
            which.append(np.full(len(h), n))
            where.append(np.arange(len(h)))
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.which, self.where = keys[order], np.concatenate(which)[order], np.concatenate(where)[order]
        self.short = {n: dict(x) for n, x in self.short.items()}

    def hits(self, text: str | None) -> list[tuple]:
        """(item_id, coverage, matched, item words, tiles) of the contaminating items."""
        get = self.vocabulary.get
        ids = np.array([get(x, -1) for x in words(text)], np.int64)
        out = self._short_hits(ids)
        at = np.flatnonzero(_runs(ids >= 0, self.least)) if len(ids) >= self.least else []
        if len(at):
            h = windows(ids, self.least)[at]
            lo = np.searchsorted(self.keys, h, "left")
            ok = lo < len(self.keys)
            ok[ok] = self.keys[lo[ok]] == h[ok]
            at, h, lo = at[ok], h[ok], lo[ok]
        if len(at):
            out += self._long_hits(ids, at, h, lo)
        return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0))

    def _short_hits(self, ids: np.ndarray) -> list[tuple]:
        out = []
        for n, known in self.short.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(_runs(ids >= 0, n))
            h, first = np.unique(windows(ids, n)[at], return_index=True) if len(at) else ([], [])
            for key, p in zip(map(int, h), first, strict=True):
                for k in known.get(key, ()):
                    item, own = self.items[k]
                    if (ids[at[p] : at[p] + n] == own).all():
                        out.append((item, 1.0, n, n, 1))
        return out

    def _long_hits(self, ids: np.ndarray, at: np.ndarray, h: np.ndarray, lo: np.ndarray) -> list[tuple]:
        # distinct seeds only: the items' covered words bound the coverage that tiles can reach
        _, first = np.unique(h, return_index=True)
        start, n = lo[first], np.searchsorted(self.keys, h[first], "right") - lo[first]
        every = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        order = np.lexsort((self.where[every], self.which[every]))
        which, where = self.which[every][order], self.where[every][order]
        gap = np.r_[np.diff(where), self.least]
        gap[np.flatnonzero(np.diff(which))] = self.least
        found, begin = np.unique(which, return_index=True)
        covered = np.add.reduceat(np.minimum(gap, self.least), begin)
        # the document's words under some seed, with a gap wherever others were left out
        under = np.zeros(len(ids) + 1, np.int64)
        np.add.at(under, at, 1)
        np.add.at(under, np.minimum(at + self.least, len(ids)), -1)
        keep = np.cumsum(under)[:-1] > 0
        near = keep | np.r_[False, keep[:-1]]
        seeded = np.where(keep, ids, -1)[near]
        out = []
        for k, most in zip(found.tolist(), covered.tolist(), strict=True):
            item, own = self.items[k]
            if most < self.threshold * len(own):
                continue
            got = tiles(seeded, own, self.least)
            matched = sum(m for _, _, m in got)
            if matched >= self.threshold * len(own):
                out.append((item, matched / len(own), matched, len(own), len(got)))
        return out


def _blocks(spark, benchmark: DataFrame, block_chars: int) -> list:
    """One function per block that fetches its rows; blocks are cut by hash, so each holds about ``block_chars`` characters."""
    items = only(benchmark, "item_id", "text")
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    return [lambda k=k: [(r[0], r[1]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()] for k in range(n)]


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per contaminated (document, item) pair: doc_id, item_id, coverage, matched_words, item_words, n_tiles."""
    spark, texts, parts = docs.sparkSession, only(docs, "doc_id", "text"), []
    for rows in _blocks(spark, benchmark, block_chars):
        shared = spark.sparkContext.broadcast(Index(rows(), least, threshold))  # bounded: one block

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for b in batches:
                rows = [(d, *hit) for d, t in zip(b["doc_id"], b["text"], strict=True) for hit in index.hits(t)]
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "coverage", "matched_words", "item_words", "n_tiles"])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

        parts.append(texts.mapInPandas(run, SCHEMA))
    return union_all(parts)


def clean_documents(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates.

    Every row is judged by its own text, whatever its id, without a shuffle: one
    pass per block of the benchmark over the rows that the blocks before left, so
    a task holds one block's index.
    """
    blocks = _blocks(docs.sparkSession, benchmark, block_chars)
    for k, rows in enumerate(blocks):
        if k:
            docs = written(docs, "decontaminated")
        docs = docs.filter(~_hit(docs.sparkSession.sparkContext.broadcast(Index(rows(), least, threshold)))(docs["text"]))  # bounded: one block
    return docs


def _hit(shared):
    @F.pandas_udf("boolean")
    def hit(text: pd.Series) -> pd.Series:
        index = shared.value
        return pd.Series([bool(index.hits(t)) for t in text], dtype=bool)

    return hit
