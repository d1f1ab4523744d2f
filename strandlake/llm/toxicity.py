"""Toxicity by weak supervision.

*Voters.* A small fixed lexicon of insults, surface patterns, and lexicon and
word-beginning patterns mined from labelled rows (tokens far more frequent in
rows marked toxic, by a log-likelihood ratio). A voter fires or abstains.

*Label model.* A generative model with a latent class per row: every voter fires
with a rate that depends on the class, the given label is one more voter with an
unknown accuracy, and all rates are estimated by expectation maximisation.
Correlated voters (a word and its own beginning) would count twice: so a voter's
rate also depends on its parent in a tree of the strongest correlations within
the classes, which is estimated anew in every round.

*Classifier.* A linear (logistic) classifier over words, word beginnings and
voters is trained on the model's posterior labels and scores every whole text.

At most about ``FIT_ROWS`` labelled rows, chosen by a hash of the id, are used
for fitting; all other work covers all rows. What reaches the driver is the
MAX_FEATURES most telling tokens and which of them these rows have.

Edge cases: null and empty texts get the score of a text without tokens; without
labelled rows of both classes the fixed lexicon alone decides; repeated rows are
scored each; an empty table gives an empty result; extra columns do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, written

#: A seed lexicon of common insults.
LEXICON = ("clown", "crap", "disgusting", "dumb", "filth", "garbage", "hate", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless")
PREFIXES = (4, 5, 6, 7)
FIT_ROWS = 10_000
MAX_VOTERS, MAX_FEATURES = 256, 4096
MIN_ROWS, MIN_G2 = 3, 10.0
#: Rounds of the label model before it looks for correlations below REPEAT.
ALONE, REPEAT = 10, 0.5
_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"\b[A-Z]{4,}\b")
_BANG = re.compile(r"[!?]{2,}")
#: Names of the surface patterns, which are features like tokens.
PATTERNS = ("#lexicon", "#shout", "#bang")


def _key(name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass")) >> 1


def word_tokens(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in PREFIXES if len(word) > n]]


def patterns(text: str, words: set[str]) -> list[str]:
    return [p for p, on in zip(PATTERNS, (any(w in words for w in LEXICON), _SHOUT.search(text), _BANG.search(text)), strict=True) if on]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def token_keys(text: str | None) -> np.ndarray:
    """Distinct token keys of one text."""
    words = words_of(text)
    names = {t for w in words for t in word_tokens(w)}
    return np.array(sorted(_key(n) for n in [*names, *patterns(text or "", words)]), np.int64)


class LabelModel:
    """A generative model of votes: a latent class, and a tree of voters per class.

    Every voter fires with a rate that depends on the class and on whether its
    parent in the tree fired, so correlations are factors of the model and not a
    correction: a voter that only repeats its parent adds no evidence. The tree
    is the maximum spanning tree by mutual information within the classes
    (Chow and Liu), of the edges that pay for their parameters. The given label
    is one more voter of unknown accuracy. Everything is estimated anew in every
    round of expectation maximisation; the tree holds near repeats only up to
    round ``ALONE``.
    """

    def __init__(self, fires: np.ndarray, given: np.ndarray, rounds: int = 25):
        n, m = fires.shape
        self.prior, self.rates = 0.0, np.zeros((2, m))
        self.given = np.array([0.02, 0.95])  # P(label says toxic | class)
        self.parent, self.correlation = np.full(m, -1), np.zeros((m, m))
        self.after = np.zeros((2, 2, m))  # P(fires | class, whether the parent fired)
        fires = fires.astype(np.float32)
        q = np.where(given == 1, 0.95, 0.02)
        for r in range(rounds):
            mass = np.array([(1 - q).sum(), q.sum()])
            self.prior = float(np.clip(mass[1] / n, 1e-6, 1 - 1e-6))
            both = np.zeros((2, m, m))
            for c, weight in enumerate((1 - q, q)):
                both[c] = (fires * weight[:, None].astype(np.float32)).T @ fires
                self.rates[c] = (weight @ fires + 0.05) / (mass[c] + 1.0)
                self.given[c] = np.clip((weight @ given + (0.1, 1.9)[c]) / (mass[c] + 2), 1e-3, 1 - 1e-3)
            # the first classes are but the given labels, within which voters of one class look correlated: a tree then would explain the class away
            self._grow(both, mass, n, r >= ALONE)
            q = self.posterior(fires, given)

    def _grow(self, both: np.ndarray, mass: np.ndarray, n: int, tree: bool) -> None:
        """The tree and its rates from the weighted numbers of rows in which two voters fire."""
        m = both.shape[1]
        gain, cov, var = np.zeros((m, m)), np.zeros((m, m)), np.zeros(m)
        for c in (0, 1):
            one, size = np.diag(both[c]), mass[c] + 1e-9
            cells = (both[c], one[:, None] - both[c], one[None] - both[c], size - one[:, None] - one[None] + both[c])
            p = one / size
            expected = (p[:, None] * p, p[:, None] * (1 - p), (1 - p)[:, None] * p, (1 - p)[:, None] * (1 - p))
            for seen, e in zip(cells, expected, strict=True):
                x = np.maximum(seen, 0) / size
                gain += size * np.where(x > 1e-12, x * np.log(np.maximum(x, 1e-12) / np.maximum(e, 1e-12)), 0.0)
            cov += both[c] - size * p[:, None] * p
            var += size * p * (1 - p)
        self.correlation = cov / np.sqrt(np.maximum(np.outer(var, var), 1e-12))
        # Prim's algorithm; an edge has two parameters per class at the price of log(n) / 2 each, less the two that it replaces
        parent, best, open_ = np.full(m, -1), np.full(m, np.log(max(n, 2))), np.ones(m, bool)
        gain = gain if tree else np.where(self.correlation > REPEAT, gain, 0.0)
        at = 0
        for _ in range(m):
            open_[at] = False
            better = open_ & (gain[at] > best)
            best[better], parent[better] = gain[at][better], at
            if not open_.any():
                break
            at = int(np.flatnonzero(open_)[np.argmax(best[open_])])
        self.parent = parent
        child = np.flatnonzero(parent >= 0)
        self.after[:] = self.rates[:, None, :]
        for c in (0, 1):
            up, one = parent[child], np.diag(both[c])
            joint, base = both[c][up, child], self.rates[c][child]
            self.after[c, 1, child] = np.clip((joint + base) / (one[up] + 1), 1e-6, 1 - 1e-6)
            self.after[c, 0, child] = np.clip((np.maximum(one[child] - joint, 0) + base) / (np.maximum(mass[c] - one[up], 0) + 1), 1e-6, 1 - 1e-6)

    def evidence(self, fires: np.ndarray) -> np.ndarray:
        """Log-odds that each row's votes give."""
        up = np.where(self.parent[None] >= 0, fires[:, np.maximum(self.parent, 0)], 0) > 0 if len(self.parent) else np.zeros(fires.shape, bool)
        on, off = np.log(self.after[1] / self.after[0]), np.log((1 - self.after[1]) / (1 - self.after[0]))
        return (np.where(fires > 0, np.where(up, on[1], on[0]), np.where(up, off[1], off[0]))).sum(1)

    def posterior(self, fires: np.ndarray, given: np.ndarray) -> np.ndarray:
        label = np.where(given == 1, np.log(self.given[1] / self.given[0]), np.log((1 - self.given[1]) / (1 - self.given[0])))
        z = np.log(self.prior / (1 - self.prior)) + self.evidence(fires) + label
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(rows: np.ndarray, cols: np.ndarray, n: int, m: int, q: np.ndarray, l2: float = 0.1, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels over sparse binary features, by accelerated gradient steps; classes weigh the same."""
    mass = np.array([(1 - q).sum(), q.sum()]).clip(1e-6)
    up, down = q * (0.5 * n / mass[1]), (1 - q) * (0.5 * n / mass[0])
    w, b = np.zeros(m), 0.0
    v, c = w.copy(), b
    # the curvature is at most a quarter of the weighted squared row norms
    size = np.bincount(rows, minlength=n) + 1.0
    rate = 1 / (0.25 * float(np.max((up + down))) * float(np.percentile(size, 99)) / 1.0 * 0.25 + l2)
    freq = np.bincount(cols, minlength=m)
    scale = 1 / np.sqrt(np.maximum(freq / n, 1e-3))  # rarer features move faster
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, v[cols], n) + c, -30, 30)))
        g = (up + down) * p - up
        new_w = v - rate * scale * (np.bincount(cols, g[rows], m) / n + l2 * v / n)
        new_b = c - rate * g.mean()
        pace = k / (k + 3)
        v, c = new_w + pace * (new_w - w), new_b + pace * (new_b - b)
        w, b = new_w, new_b
    return w, float(b)


class Model:
    """Weights by token key, and a bias."""

    def __init__(self, weights: dict[int, float], bias: float, voters: list[int] | None = None, labels: LabelModel | None = None):
        self.weights, self.bias, self.voters, self.labels = weights, bias, voters or [], labels
        self._cache: dict[str, tuple] = {}

    def _of(self, word: str) -> tuple:
        got = self._cache.get(word)
        if got is None:
            if len(self._cache) > 200_000:
                self._cache.clear()
            got = self._cache[word] = tuple(k for t in word_tokens(word) if (k := _key(t)) in self.weights)
        return got

    def score(self, text: str | None) -> float:
        words = words_of(text)
        of = self._of
        keys = {k for w in words for k in of(w)}
        keys.update(k for p in patterns(text or "", words) if (k := _key(p)) in self.weights)
        z = self.bias + sum(self.weights[k] for k in sorted(keys))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def surprise(df: Column, df1: Column, n: int, n1: int) -> Column:
    """Log-likelihood ratio of a token's rows among toxic and other rows."""
    def part(x: Column, e: Column) -> Column:
        return F.when(x > 0, x * F.log(x / e)).otherwise(0.0)

    n0, df0 = n - n1, df - df1
    return 2 * (part(df1, df * n1 / n) + part(df0, df * n0 / n) + part(n1 - df1, (n - df) * n1 / n) + part(n0 - df0, (n - df) * n0 / n))


def fit_rows(names: np.ndarray, toxic: np.ndarray, rows: np.ndarray, cols: np.ndarray, given: np.ndarray) -> Model:
    """Label model and classifier from the chosen tokens (most telling first) and the (row, token) pairs that occur."""
    n = len(given)
    fixed = np.isin(names, [_key(p) for p in PATTERNS])
    voters = np.flatnonzero(toxic | fixed)[:MAX_VOTERS]
    at = np.full(len(names), -1)
    at[voters] = np.arange(len(voters))
    fires = np.zeros((n, len(voters)), np.float32)
    on = at[cols] >= 0
    fires[rows[on], at[cols[on]]] = 1
    labels = LabelModel(fires, given)
    w, b = fit_linear(rows, cols, n, len(names), labels.posterior(fires, given))
    return Model({int(k): float(x) for k, x in zip(names, w, strict=True)}, b, [int(names[k]) for k in voters], labels)


def fit(docs: DataFrame, labels: DataFrame, fit_rows_: int = FIT_ROWS) -> Model:
    """Train on the rows of ``docs`` that ``labels`` (doc_id, toxic) marks: at most about ``fit_rows_`` of them, chosen by hash.

    Tokens are counted on the executors, summed per batch before the shuffle; the
    driver gets the MAX_FEATURES most telling ones, and then which of them each
    row of the sample has.
    """
    fallback = Model({_key("#lexicon"): 6.0}, -3.0)
    marks = only(labels, "doc_id", "toxic").filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
    total = marks.count()
    marks = marks.filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < int(min(1.0, fit_rows_ / max(total, 1)) * 1_000_000))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # the bounded sample of labels is the small side
    sample = only(docs, "doc_id", "text").join(F.broadcast(marks) if total <= 4 * fit_rows_ else marks, "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [token_keys(t) for t in b["text"]]
            size = np.array([len(k) for k in keys])
            one = np.repeat((b["toxic"] == 1).to_numpy(), size)
            name, inverse = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
            yield pd.DataFrame({"key": np.r_[name, -1], "df": np.r_[np.bincount(inverse, minlength=len(name)), len(b)], "df1": np.r_[np.bincount(inverse, one, len(name)).astype(np.int64), (b["toxic"] == 1).sum()]})

    counts = written(sample.mapInPandas(count, "key long, df long, df1 long").groupBy("key").agg(F.sum("df").alias("df"), F.sum("df1").alias("df1")).filter(f"df >= {MIN_ROWS} OR key = -1"), "toxicity-counts")
    n, n1 = counts.filter("key = -1").select("df", "df1").first() or (0, 0)  # key -1 counts the rows themselves
    if not n1 or n1 == n:
        return fallback
    fixed = F.col("key").isin(*[_key(p) for p in PATTERNS])
    g2 = surprise(F.col("df"), F.col("df1"), n, n1)
    told = counts.filter("key >= 0").withColumn("g2", g2).filter(fixed | (F.col("g2") >= MIN_G2)).orderBy(F.desc("g2"), "key").limit(MAX_FEATURES)
    top = told.select("key", (F.col("df1") * (n - n1) > (F.col("df") - F.col("df1")) * n1).alias("toxic")).collect()  # MAX_FEATURES rows at most
    if not top:
        return fallback
    names, toxic = np.array([r[0] for r in top], np.int64), np.array([r[1] for r in top])

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = np.argsort(names)
        for b in batches:
            found = []
            for t in b["text"]:
                k = token_keys(t)
                at = np.searchsorted(names, k, sorter=order).clip(max=len(names) - 1)
                found.append(np.sort(order[at][names[order[at]] == k]).astype(np.int32))
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "toxic": b["toxic"].array, "at": found})

    rows = sample.mapInPandas(mark, "doc_id long, toxic int, at array<int>").toArrow().to_pandas().sort_values("doc_id", kind="stable")
    given = (rows["toxic"].to_numpy() == 1).astype(np.int64)
    cols = np.concatenate([np.zeros(0, np.int32), *rows["at"]]).astype(np.int64)
    return fit_rows(names, toxic, np.repeat(np.arange(len(rows)), rows["at"].map(len)), cols, given)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_FEATURES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "score": [shared.value.score(t) for t in b["text"]]})

    return only(docs, "doc_id", "text").mapInPandas(run, "doc_id long, score double")


def clean_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``; row by row, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in text], dtype=float)

    return docs.filter(scored(docs["text"]) < threshold)
