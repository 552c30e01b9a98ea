"""Quality by ordinal regression: one weight vector over hashed text, ordered thresholds.

The cumulative-link model says P(grade <= k) = logistic(threshold_k - w.x) with thresholds that
ascend: all grades share the weights w, so a text's score w.x moves it along one scale.  A text
gets its expected grade and the probability that its grade is at least the one asked for.

Features are the different words of a text, their beginnings, and a few measures of its form,
hashed to 2^18 weights.
Weights are found by FTRL-proximal with an L1 penalty, which leaves at zero what the ratings do
not speak for; most words of a new text are such, however long it is.

Fitting takes a bounded sample of the rated rows (``sample``, chosen by a hash of the id); only
that sample's features come to the driver.  Scoring is one pass over all texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from nearwave.llm.common import full_text

SAMPLE = 6_000
#: Features of the sample that reach the driver, at most (four bytes each).
SAMPLE_FEATURES = 30_000_000
BITS = 18
EPOCHS = 8
#: Lengths in bytes of the word beginnings that are features too: kin of a rated word then count.
PREFIXES = (4, 6)
_MASK = (1 << BITS) - 1
_SYMBOLS = "#*$%&|<>!=@{}[]\\^~_"
_EDGES = b".,;:!?\"'()[]"


def _bucket(value: float, edges: tuple[float, ...]) -> int:
    return sum(value > e for e in edges)


def features(text: str) -> np.ndarray:
    """Indexes of a text's features, each once, in ascending order."""
    data = text.encode()
    words = data.split()
    n_words = max(1, len(words))
    letters = max(1, len(text))
    plain = {w.lower().strip(_EDGES) for w in set(words)}
    plain |= {w[:n] + b"\0" for w in plain for n in PREFIXES if len(w) > n}
    found = {zlib.crc32(w) & _MASK for w in plain}
    forms = {
        "symbols": _bucket(sum(map(text.count, _SYMBOLS)) / letters, (0.0, 0.005, 0.02, 0.05, 0.1, 0.2)),
        "capitals": _bucket(sum(c.isupper() for c in text) / letters, (0.01, 0.05, 0.15, 0.3, 0.6)),
        "repeats": _bucket(1 - len(set(words)) / n_words, (0.1, 0.3, 0.5, 0.7, 0.9)),
        "length": _bucket(n_words, (5, 20, 50, 200, 1000, 5000)),
        "lines": _bucket((text.count("\n") + 1) / n_words, (0.02, 0.1, 0.3, 0.6)),
    }
    found |= {zlib.crc32(f"\0{name}:{k}".encode()) & _MASK for name, k in forms.items()}
    return np.array(sorted(found), np.int32)


@pandas_udf(T.ArrayType(T.IntegerType()))
def features_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([features(t) for t in texts])


@dataclass
class OrdinalModel:
    """Weights, and thresholds between the grades 0 .. len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade) per score and grade."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - np.asarray(scores)[:, None], -40, 40)))
        edges = np.concatenate([np.zeros((len(below), 1)), below, np.ones((len(below), 1))], axis=1)
        return np.diff(edges, axis=1)

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() for r in rows], float)


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, epochs: int = EPOCHS, seed: int = 5) -> OrdinalModel:
    """Cumulative-link regression by FTRL-proximal; thresholds by gradient steps, kept in order.

    Rows of each grade weigh alike in sum.  Without rows, or with a single grade, the weights
    are zero and the thresholds say what was seen.
    """
    alpha, beta, l1, l2 = 0.3, 1.0, 8.0, 1e-3
    size = 1 << BITS
    z, squares, w = np.zeros(size), np.zeros(size), np.zeros(size)
    counts = np.bincount(grades, minlength=n_grades).astype(float)
    share = (np.cumsum(counts) + 0.5) / (counts.sum() + 1.0)
    balance = np.sqrt(counts.sum() / np.maximum(counts, 1) / n_grades)
    thresholds = np.maximum.accumulate(np.log(share / np.maximum(1 - share, 1e-3))[:-1] + np.arange(n_grades - 1) * 1e-3)
    rng = np.random.default_rng(seed)
    for epoch in range(epochs if (counts > 0).sum() > 1 else 0):
        rate = 0.05 / (1 + epoch)
        for i in rng.permutation(len(rows)):
            x, k = rows[i], int(grades[i])
            active = z[x]
            w[x] = np.where(
                np.abs(active) > l1, -(active - np.sign(active) * l1) / ((beta + np.sqrt(squares[x])) / alpha + l2), 0.0
            )
            score = w[x].sum()
            cut = 1 / (1 + np.exp(-np.clip(thresholds - score, -40, 40)))
            upper = cut[k] if k < n_grades - 1 else 1.0
            lower = cut[k - 1] if k else 0.0
            weight = balance[k]
            # d(-log P)/d(score) = 1 - upper - lower, of a difference of logistic functions.
            slope = weight * (1.0 - upper - lower)
            p = max(upper - lower, 1e-9)
            if k < n_grades - 1:
                thresholds[k] += rate * weight * min(upper * (1 - upper) / p, 5.0)
            if k:
                thresholds[k - 1] -= rate * weight * min(lower * (1 - lower) / p, 5.0)
            thresholds = np.maximum.accumulate(thresholds)
            step = (np.sqrt(squares[x] + slope * slope) - np.sqrt(squares[x])) / alpha
            z[x] += slope - step * w[x]
            squares[x] += slope * slope
    active = np.abs(z) > l1
    w = np.where(active, -(z - np.sign(z) * l1) / ((beta + np.sqrt(squares)) / alpha + l2), 0.0)
    return OrdinalModel(w.astype(np.float32), thresholds)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labels: 0 toxic, 1 of low quality, 2 good; rows without a label are left out."""
    return labels.filter(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | (F.col("toxic") == 1))).select(
        "doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade")
    )


def fit_on(docs: DataFrame, ratings: DataFrame, n_grades: int, sample: int = SAMPLE) -> OrdinalModel:
    """The model of at most ``sample`` rated rows: those whose (doc_id, grade) hash lowest.

    Fewer if their features exceed ``SAMPLE_FEATURES``, as thousands of book-long texts would.
    A doc_id rated twice counts twice, with each of its rows in ``docs``.
    """
    chosen = ratings.select("doc_id", "grade", F.xxhash64("doc_id", "grade").alias("h")).orderBy("h", "doc_id", "grade")
    chosen = chosen.limit(sample).select(F.col("doc_id").alias("rated"), "grade")
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("rated"))  # at most ``sample`` rows of two numbers
        .select(F.xxhash64("text", "doc_id", "grade").alias("h"), "grade", features_of(full_text()).alias("x"))
        .orderBy("h", "grade")
        .limit(sample)
    )
    # Of the sample's rows, in hash order, as many as stay below the bound on features in all.
    so_far = F.sum(F.size("x")).over(Window.orderBy("h", "grade").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("so_far", so_far).filter(F.col("so_far") <= SAMPLE_FEATURES).select("grade", "x").toPandas()
    return fit([np.asarray(x, np.int32) for x in rows["x"]], rows["grade"].to_numpy(np.int64), n_grades)


def quality_grades(docs: DataFrame, model: OrdinalModel, at_least: int, least: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, expected_grade, p_tail and kept.

    ``p_tail`` is the probability of a grade of ``at_least`` or more, kept whether it reaches
    ``least``.  A null text counts as empty; null ids stay, repeated rows are scored each, an
    empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2^18 weights

    @pandas_udf("expected_grade double, p_tail double")
    def graded_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            p = m.probabilities(m.scores([features(t) for t in texts]))
            yield pd.DataFrame({"expected_grade": p @ np.arange(p.shape[1]), "p_tail": p[:, at_least:].sum(axis=1)})

    return docs.select("doc_id", graded_batches(full_text()).alias("g")).select(
        "doc_id", "g.expected_grade", "g.p_tail", (F.col("g.p_tail") >= least).alias("kept")
    )


def quality_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fits on the labels and grades every row of ``docs``; kept are texts that are probably good."""
    return quality_grades(docs, fit_on(docs, graded(labels), 3, sample), at_least=2)
