"""Language identification by hierarchical discrimination.

The first level predicts the language *family*, the second the language within
it: one-versus-one linear support vector machines vote among the languages of
the predicted family, where close relatives are told apart by features trained
on them alone. Features are hashed character 1- to 4-grams of the whole
lower-cased text, as the square root of their frequency, scaled to unit length.

Training uses at most about ``FIT_PER_LANGUAGE`` labelled rows per language for
the machines inside a family, and as many per family for those between families,
chosen by a hash of the id. Every machine is a task of its own: it gets the
vectors of its two classes, at most twice that many, and is fitted by dual
coordinate descent on an executor. The driver gets the weights only: pairs of
families and of close relatives, whatever the number of rows. Everything else
covers all rows.

Edge cases: null and letterless texts are ``und`` with score 0; without any
labelled row all texts are ``und``; with one language everything else is that
language; an unknown label forms a family of its own; an empty table gives an
empty result; extra columns do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, written

#: Families of language codes.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indic": ("as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "sa", "sd", "si", "ur"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "uz"),
    "semitic": ("am", "ar", "he", "mt"),
    "sinitic": ("yue", "zh"),
}
FIT_PER_LANGUAGE = 1500
DIMS_LOG2, ORDERS = 15, (1, 2, 3, 4)
_LETTER = re.compile(r"[^\W\d_]")
_PIECE = 1 << 20


def family(lang: str) -> str:
    base = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, langs in FAMILIES.items() if base in langs), lang)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(indices, unit-length values) of the hashed character n-grams; None without letters."""
    if text is None or not _LETTER.search(text):
        return None
    counts = np.zeros(1 << DIMS_LOG2, np.float32)
    shift, mix = np.uint32(32 - DIMS_LOG2), np.uint32(2654435761)
    overlap = max(ORDERS) - 1
    for at in range(0, len(text), _PIECE):  # whole text, in overlapping pieces of bounded memory
        c = np.frombuffer(text[max(0, at - overlap) : at + _PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(c), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            h = (h[: len(c) - n + 1] * np.uint32(0x01000193) + np.uint32(n)) ^ c[n - 1 :]
            new = h if at == 0 else h[max(0, overlap - n + 1) :]
            counts += np.bincount((new * mix) >> shift, minlength=len(counts))
    index = np.flatnonzero(counts)
    value = np.sqrt(counts[index])
    return index, value / np.sqrt(np.float32(counts.sum()))


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 4.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (last one the bias) of an L2-loss linear machine, by dual coordinate descent; classes weigh the same."""
    w, rng = np.zeros((1 << DIMS_LOG2) + 1), np.random.default_rng(seed)
    share = {s: max(1, (y == s).sum()) for s in (-1, 1)}
    diag = np.array([share[s] * 2 / (2 * cost * len(y)) for s in y])
    alpha, norm = np.zeros(len(y)), np.array([float((v * v).sum()) + 1 for _, v in rows])
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(len(y)):
            i, v = rows[k]
            g = y[k] * (w[i] @ v + w[-1]) - 1 + diag[k] * alpha[k]
            new = max(0.0, alpha[k] - g / (norm[k] + diag[k]))
            if step := (new - alpha[k]) * y[k]:
                w[i] += step * v
                w[-1] += step
                moved = max(moved, abs(step))
                alpha[k] = new
        if moved < 1e-3:
            break
    return w


Machine = tuple[str | None, str, str]


def machines_of(langs: list[str]) -> list[Machine]:
    """(family or None, first, second) of all machines: families against each other, and the languages of each family."""
    members: dict[str, list[str]] = {}
    for x in sorted(set(langs)):
        members.setdefault(family(x), []).append(x)
    return [(None, a, b) for a, b in combinations(sorted(members), 2)] + [(f, a, b) for f, m in sorted(members.items()) for a, b in combinations(m, 2)]


class Model:
    """Pairwise machines between families, and between the languages of each family."""

    def __init__(self, langs: list[str], weights: dict[Machine, np.ndarray] | None = None):
        self.langs = sorted(set(langs))
        self.members: dict[str, list[str]] = {}
        for x in self.langs:
            self.members.setdefault(family(x), []).append(x)
        self.machines = machines_of(self.langs)
        size = (1 << DIMS_LOG2) + 1
        # a pair without rows on both sides decides nothing
        self.weights = np.array([(weights or {}).get(m, np.zeros(size)) for m in self.machines], np.float32).reshape(len(self.machines), size)

    def _vote(self, level: str | None, names: list[str], margins: dict) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        votes = dict.fromkeys(names, 0.0)
        for a, b in combinations(names, 2):
            p = 1 / (1 + np.exp(-2.5 * margins[level, a, b]))
            # the winner of a pair gets a vote; closeness only breaks ties
            votes[a] += float(p > 0.5) + 1e-3 * p
            votes[b] += float(p <= 0.5) + 1e-3 * (1 - p)
        best = max(names, key=lambda x: votes[x])
        against = [margins[level, a, b] * (1 if a == best else -1) for a, b in combinations(names, 2) if best in (a, b)]
        return best, float(1 / (1 + np.exp(-2.5 * min(against))))

    def predict(self, text: str | None) -> tuple[str, float]:
        got = features(text)
        if got is None or not self.langs:
            return "und", 0.0
        i, v = got
        m = self.weights[:, i] @ v + self.weights[:, -1] if len(self.weights) else []
        margins = dict(zip(self.machines, map(float, m), strict=True))
        f, p = self._vote(None, sorted(self.members), margins)
        lang, q = self._vote(f, self.members[f], margins)
        return lang, p * q


def fit(labelled: DataFrame, per_language: int = FIT_PER_LANGUAGE) -> Model:
    """Train on (doc_id, text, lang); at most about ``per_language`` rows of each language, chosen by hash."""
    labelled = only(labelled, "doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return Model([])
    spark, machines = labelled.sparkSession, machines_of(list(counts))
    size = {f: sum(family(x) == f for x in counts) for f in map(family, counts)}
    # (machine, side) of each language; the share of its rows that a machine between families takes is smaller
    roles = [(lang, k, 1 if (lang if level else family(lang)) == a else -1, 1.0 if level else 1.0 / size[family(lang)])
             for k, (level, a, b) in enumerate(machines) for lang in counts if (lang if level else family(lang)) in (a, b) and (not level or family(lang) == level)]
    million = lambda x: int(min(1.0, x) * 1_000_000)
    order = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, million(per_language / n))])
    sample = labelled.withColumn("at", order).filter(F.col("at") < share[F.col("lang")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(d, at, lang, *x) for d, t, at, lang in zip(b["doc_id"], b["text"], b["at"], b["lang"], strict=True) if (x := features(t))]
            if got:
                yield pd.DataFrame({"doc_id": pd.array([g[0] for g in got], "Int64"), "at": [g[1] for g in got], "lang": [g[2] for g in got], "i": [g[3].astype(np.int32) for g in got], "v": [g[4].astype(np.float32) for g in got]})

    rows = written(sample.mapInPandas(run, "doc_id long, at long, lang string, i array<int>, v array<float>"), "language-features")
    if not machines:
        return Model(list(counts))
    part = spark.createDataFrame([(lang, k, y, million(per_language / counts[lang] * f)) for lang, k, y, f in roles], "lang string, machine int, y int, below int")
    given = rows.join(F.broadcast(part), "lang").filter(F.col("at") < F.col("below"))  # one row per language and machine

    def train(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["doc_id", "lang"], kind="stable")
        y = g["y"].to_numpy()
        if len(set(y)) == 2:
            w = fit_svm([(np.asarray(i), np.asarray(v)) for i, v in zip(g["i"], g["v"], strict=True)], y)
        else:  # all rows on one side: always that side
            w = np.r_[np.zeros(1 << DIMS_LOG2), y[0]]
        return pd.DataFrame({"machine": [key[0]], "w": [w.astype(np.float32)]})

    found = given.groupBy("machine").applyInPandas(train, "machine int, w array<float>").toArrow().to_pandas()  # one row per machine
    return Model(list(counts), {machines[k]: np.asarray(w) for k, w in zip(found["machine"], found["w"], strict=True)})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: pairs of languages x 2^DIMS_LOG2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [shared.value.predict(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "lang_pred": [g[0] for g in got], "score": [float(g[1]) for g in got]})

    return only(docs, "doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")
