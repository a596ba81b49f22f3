"""Severity of toxic text by cumulative-link ordinal regression over sparse word features (operator 2).

P(grade >= j) = logistic(w . x - t_j) with one weight vector for all thresholds t_1 < t_2 < ...; the expected
severity is the sum of these over j. Features are words and their first letters, so that an unseen form of a
telling stem counts as well; each is valued log(1 + occurrences).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwright.llm.common import discard, materialize, sample_by_hash

WORD = re.compile(r"\w+")
#: Labelled rows the model is fitted on at most, those whose id hashes lowest.
SAMPLE_ROWS = 8000
#: Lengths of the beginnings that are features beside the whole word.
STEMS = (4, 5, 6, 7)
#: Weights smaller than this are dropped after fitting.
LEAST_WEIGHT = 0.02
#: Share of the chosen features that may depend on the toxic label by chance alone.
FALSE_RATE = 0.05


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features(word: str) -> list[str]:
    """A word and its beginnings, marked by a star."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) >= n]]


def count_features(text: str | None) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(words_of(text)).items():
        for f in features(word):
            out[f] += n
    return out


def labelled_words(docs: DataFrame, labels: DataFrame, label_col: str, bound: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label, words, counts), words being features, of at most `bound` labelled ids that have a document, a row each:
    of a repeated id the least text with its least label. Null labels and ids are left out."""
    sample = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("label"))
    sample = sample_by_hash(sample, "k", bound)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            counted = [count_features(t) for t in texts]
            yield pa.record_batch(
                [batch.column(0), pa.array([list(c) for c in counted], pa.list_(pa.string())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int64()))],
                names=["label", "words", "counts"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "k")
    rows = rows.groupBy("k").agg(F.min(F.struct("text", "label")).alias("x")).select("x.label", "x.text")
    return rows.mapInArrow(run, "label int, words array<string>, counts array<long>")


def dependence(a, b, n: float, m: float) -> np.ndarray:
    """Log-likelihood ratios of features that a of n toxic and b of m other rows have."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    share = (a + b) / (n + m)

    def part(count, expected):
        return np.where(count > 0, 2 * count * np.log(np.maximum(count, 1) / np.maximum(expected, 1e-300)), 0.0)

    return part(a, n * share) + part(b, m * share) + part(n - a, n * (1 - share)) + part(m - b, m * (1 - share))


def least_dependence(a, b, features, n: float, m: float, rate: float = FALSE_RATE) -> float:
    """The ratio from which on at most `rate` of the features are expected to get there by chance.

    features counts those that a toxic and b other rows have. Only the ones in enough rows to get there at all
    can do so by chance, so neither small nor large tables need a bound on rows. Infinite if no ratio will do.
    """
    a, b, features = np.asarray(a, float), np.asarray(b, float), np.asarray(features, float)
    g, own = dependence(a, b, n, m), np.minimum(a + b, n)
    best = dependence(own, a + b - own, n, m)
    order, rank = np.argsort(-g, kind="stable"), np.argsort(best, kind="stable")
    level, reached = g[order], np.cumsum(features[order])[np.searchsorted(-g[order], -g[order], side="right") - 1]
    able = np.concatenate((np.cumsum(features[rank][::-1])[::-1], [0.0]))[np.searchsorted(best[rank], level - 1e-9)]
    chance = np.array([math.erfc(math.sqrt(max(x, 0.0) / 2)) for x in level])
    good = np.flatnonzero(chance * able <= rate * reached)
    return float(level[good[-1]]) if len(good) else math.inf


def telling(known: DataFrame, rate: float = FALSE_RATE) -> list[str]:
    """The features of labelled_words() rows that depend on the label, `rate` of them by chance at most; counted
    by Spark, only these and how many features share each pair of counts reach the driver."""
    sums = known.agg(F.count_if(F.col("label") > 0).alias("n"), F.count_if(F.col("label") == 0).alias("m")).first()
    n, m = float(sums["n"]), float(sums["m"])
    if not n or not m:
        return []
    seen = materialize(known.select("label", F.explode("words").alias("w")).groupBy("w").agg(F.count_if(F.col("label") > 0).alias("a"), F.count_if(F.col("label") == 0).alias("b")), "seen")
    pairs = seen.groupBy("a", "b").agg(F.count("*").alias("features")).toPandas().sort_values(["a", "b"])
    a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    enough = dependence(a, b, n, m) >= least_dependence(a, b, pairs["features"].to_numpy(), n, m, rate) - 1e-9
    chosen = seen.sparkSession.createDataFrame([(int(x), int(y)) for x, y in zip(a[enough], b[enough], strict=True)], "a long, b long")
    out = sorted(r["w"] for r in seen.join(F.broadcast(chosen), ["a", "b"]).select("w").collect())
    discard(seen)
    return out


def only_words(known: DataFrame, vocabulary: list[str]) -> DataFrame:
    """labelled_words() rows with the features of a vocabulary only."""
    shared = known.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kept = [[(w, n) for w, n in zip(ws.as_py(), ns.as_py(), strict=True) if w in shared.value] for ws, ns in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.record_batch(
                [batch.column(0), pa.array([[w for w, _ in k] for k in kept], pa.list_(pa.string())), pa.array([[n for _, n in k] for k in kept], pa.list_(pa.int64()))], names=["label", "words", "counts"]
            )

    return known.select("label", "words", "counts").mapInArrow(run, "label int, words array<string>, counts array<long>")


class SparseRows:
    """Bag-of-words rows over a list of features."""

    def __init__(self, counted: list[tuple[list[str], list[int]]], vocabulary: list[str]):
        self.vocabulary = {w: i for i, w in enumerate(vocabulary)}
        rows, cols, vals = [], [], []
        for r, (words, counts) in enumerate(counted):
            for w, n in zip(words, counts, strict=True):
                if (c := self.vocabulary.get(w)) is not None:
                    rows.append(r)
                    cols.append(c)
                    vals.append(n)
        self.n, self.rows, self.cols, self.counts = len(counted), np.array(rows, np.int64), np.array(cols, np.int64), np.array(vals, float)

    def dot(self, w: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.cols] * values, minlength=self.n)

    def back(self, g: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=g[self.rows] * values, minlength=len(self.vocabulary))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def minimise(loss, p: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with step halving; loss(p) gives the value and its gradient."""
    value, g = loss(p)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, back = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            back.append(a)
            d -= a * y
        if pairs:
            s, y = pairs[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(back), strict=True):
            d += s * (a - (y @ d) / (s @ y))
        size = 1.0 if pairs else 1.0 / max(1.0, float(np.abs(g).sum()))
        while size > 1e-10:
            new_value, new_g = loss(p - size * d)
            if new_value <= value - 1e-4 * size * (g @ d):
                break
            size /= 2
        else:
            break
        if (d @ (g - new_g)) > 1e-14:
            pairs = [*pairs, (-size * d, new_g - g)][-memory:]
        done = value - new_value < 1e-9
        p, value, g = p - size * d, new_value, new_g
        if done:
            break
    return p


class OrdinalModel:
    """Word weights and ordered thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]):
        self.weights, self.thresholds, self._seen = weights, thresholds, {}

    def __getstate__(self):
        return {"weights": self.weights, "thresholds": self.thresholds, "_seen": {}}

    def _known(self, word: str) -> tuple[str, ...]:
        """The features of a word that have a weight; remembered for a bounded number of words."""
        out = self._seen.get(word)
        if out is None:
            if len(self._seen) > 300_000:
                self._seen.clear()
            out = self._seen[word] = tuple(f for f in features(word) if f in self.weights)
        return out

    @classmethod
    def fit(cls, data: SparseRows, grades: np.ndarray, penalty: float = 1e-4, steps: int = 120) -> OrdinalModel:
        """Maximum penalised likelihood by limited-memory BFGS; gaps between thresholds stay positive."""
        levels = int(grades.max(initial=0))
        if levels == 0:  # nothing graded above zero: never toxic
            return cls({}, [math.inf])
        x, m, each = np.log1p(data.counts), len(data.vocabulary), np.arange(data.n)

        def cuts(t):
            return np.cumsum(np.concatenate((t[:1], np.exp(t[1:]))))

        def loss(p):
            w, t = p[:m], p[m:]
            z = data.dot(w, x)
            above = np.concatenate((np.ones((data.n, 1)), _sigmoid(z[:, None] - cuts(t)), np.zeros((data.n, 1))), axis=1)
            here = np.maximum(above[each, grades] - above[each, grades + 1], 1e-12)
            slope = above * (1 - above)
            high, low = slope[each, grades] / here / data.n, slope[each, grades + 1] / here / data.n
            g_cut = np.zeros(levels + 2)
            np.add.at(g_cut, grades, high)
            np.add.at(g_cut, grades + 1, -low)
            g_t = np.cumsum(g_cut[1:-1][::-1])[::-1] * np.concatenate(([1.0], np.exp(t[1:])))
            return -np.log(here).mean() + penalty / 2 * (w @ w), np.concatenate((data.back(low - high, x) + penalty * w, g_t))

        p = minimise(loss, np.concatenate((np.zeros(m), [2.0], np.zeros(levels - 1))), steps)
        return cls({k: float(p[i]) for k, i in data.vocabulary.items() if abs(p[i]) >= LEAST_WEIGHT}, cuts(p[m:]).tolist())

    def at_least(self, text: str | None) -> list[float]:
        """[P(grade >= 1), P(grade >= 2), ...] of one text."""
        seen: dict[str, int] = {}
        for word in words_of(text):
            for f in self._known(word):
                seen[f] = seen.get(f, 0) + 1
        z = math.fsum([self.weights[k] * math.log1p(n) for k, n in seen.items()])
        return [0.5 * (1 + math.tanh(0.5 * max(-1400.0, z - t))) for t in self.thresholds]


def severity_grades(data: SparseRows, toxic: np.ndarray, levels: int = 3, least_odds: float = 20.0, least_docs: int = 20) -> np.ndarray:
    """Grades 0..levels for 0/1 labels: 0 if not toxic, else by how much a text uses the telling features.

    Telling features occur in least_docs toxic rows and least_odds times as often as in the others; the toxic
    rows are cut into `levels` groups of like size by the sum of their values.
    """
    toxic, m = toxic.astype(bool), len(data.vocabulary)
    own, rest = (np.bincount(data.cols[pick[data.rows]], minlength=m) for pick in (toxic, ~toxic))
    odds = (own + 0.5) / (toxic.sum() + 1) / ((rest + 0.5) / ((~toxic).sum() + 1))
    strong = ((odds >= least_odds) & (own >= min(least_docs, max(1, toxic.sum() // 10)))).astype(float)
    amount = data.dot(strong, np.log1p(data.counts))
    grades = np.zeros(data.n, np.int64)
    if toxic.any():
        cuts = np.quantile(amount[toxic], [i / levels for i in range(1, levels)])
        grades[toxic] = 1 + np.searchsorted(cuts, amount[toxic], side="left")
    return grades


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> OrdinalModel:
    """The model of a bounded sample of (doc_id, toxic 0/1) labels; without a toxic label nothing is toxic."""
    known = materialize(labelled_words(docs, labels, "toxic", bound), "labelled")
    vocabulary = telling(known)
    rows = only_words(known, vocabulary).collect()  # bound rows at most, each with its telling features
    discard(known)
    rows.sort(key=lambda r: (r["label"], r["words"], r["counts"]))
    data = SparseRows([(r["words"], r["counts"]) for r in rows], vocabulary)
    toxic = np.array([r["label"] for r in rows], np.int64)
    return OrdinalModel.fit(data, severity_grades(data, toxic))


def severity(df: DataFrame, model: OrdinalModel, text_col: str = "text"):
    """A column array<double>: P(grade >= j) for each j. Null and empty texts get the intercepts' values."""
    import pandas as pd

    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for texts in batches:
            yield pd.Series([shared.value.at_least(t) for t in texts])

    run.__annotations__ = {}
    return F.pandas_udf(run, "array<double>", F.PandasUDFType.SCALAR_ITER)(F.col(text_col).cast("string"))


def score_severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_severity, severity_grade, p_toxic, toxic) for every row; toxic: P(grade >= 1) >= 0.5."""
    p = docs.select(F.col(id_col).alias("doc_id"), severity(docs, model, text_col).alias("p"))
    return p.select(
        "doc_id",
        F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("expected_severity"),
        F.size(F.filter("p", lambda x: x >= 0.5)).cast("long").alias("severity_grade"),
        F.col("p")[0].alias("p_toxic"),
        (F.col("p")[0] >= 0.5).alias("toxic"),
    )


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that aren't toxic; null and empty texts stay."""
    return docs.where(severity(docs, model, text_col)[0] < 0.5)
