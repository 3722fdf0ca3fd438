"""Quality classifier: regularised quadratic discriminant over document statistics.

``statistics`` turns a text into ``FEATURES`` numbers, ``fit`` learns one Gaussian
for each class from the moments of all labelled training rows, ``score`` gives
the probability of class 1.

Method: the statistics are ratios and logarithms, transformed to have roughly
normal distributions (arc sine of the root for shares, logarithm for counts). A
class's covariance shrinks towards the pooled one (``TO_POOLED``) and towards a
multiple of its diagonal (``TO_DIAGONAL``). A score is the logistic function of
the difference of the classes' Mahalanobis log densities and log priors; the
inverses of the Cholesky factors are computed once and go to the tasks with the
means (some hundred numbers).

Only the text is ever an input. Moments are summed by partition in numpy and then
in Spark, so what reaches the driver doesn't grow with the data.

Defined results: null counts as an empty text, whose statistics are those of no
words; documents without a label aren't learned from, one with several labels
counts once with the least; if a class has no training rows, every score is the
share of class 1 (0.5 without any labels). Columns of the input stay, but for
those with the name of an output.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint

FEATURES = ("words", "word_length", "upper", "symbols", "stops", "digits", "repeats", "distinct", "top_word", "lines", "entropy", "other_letters")
TO_POOLED, TO_DIAGONAL = 0.1, 0.02
THRESHOLD = 0.3
PLAIN = 10
#: Byte classes.
UPPER, DIGIT, LOWER = (np.isin(np.arange(256), list(x)) for x in (range(65, 91), range(48, 58), range(97, 123)))
SPACE, STOP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32]), np.isin(np.arange(256), list(b".,;:'-\"?()"))
HIGH = np.arange(256) >= 128
SYMBOL = ~(UPPER | DIGIT | LOWER | SPACE | STOP | HIGH)
CLASSES = np.stack([UPPER, SYMBOL, STOP, DIGIT, HIGH, SPACE, LOWER]).astype(np.float64)


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode()
    words = data.split()
    n = max(1, len(words))
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, symbols, stops, digits, high, space, lower = (CLASSES @ bytes_).tolist()
    solid = max(1.0, len(data) - space)
    counts = Counter(words)
    share = bytes_[bytes_ > 0] / max(1, len(data))
    # shares as if PLAIN more words (of five letters each) of plain prose stood there, so that those of short texts don't swing
    letters = 5 * PLAIN
    shares = [
        (upper + 0.03 * letters) / (upper + lower + high + letters),
        (symbols + 0.001 * letters) / (solid + letters),
        (stops + 0.04 * letters) / (solid + letters),
        (digits + 0.001 * letters) / (solid + letters),
        (sum(map(eq, words, words[1:])) + 0.01 * PLAIN) / (n + PLAIN),
        (len(counts) + 0.9 * PLAIN) / (n + PLAIN),
        (max(counts.values(), default=0) + 0.05 * PLAIN) / (n + PLAIN),
        (bytes_[10] + 0.02 * PLAIN) / (n + PLAIN),
        (high + 0.02 * letters) / (solid + letters),
    ]
    upper, symbols, stops, digits, repeats, distinct, top, lines, high = np.arcsin(np.sqrt(shares)).tolist()
    return [np.log1p(len(words)), np.log1p(solid / n), upper, symbols, stops, digits, repeats, distinct, top, lines, float(-(share * np.log2(share)).sum()), high]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _statistics(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        flat = np.array([statistics(t.as_py()) for t in batch], np.float64).reshape(-1, len(FEATURES))
        yield pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * len(FEATURES), pa.array(flat.ravel()))


def with_statistics(df: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    return df.withColumn(out, _statistics(F.col(text)))


@dataclass
class Model:
    """By class (0, 1): log prior less half the log determinant, mean, inverse of the Cholesky factor."""

    offsets: list[float]
    means: list[np.ndarray]
    inverses: list[np.ndarray]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.prior)
        log = [o - 0.5 * np.square((x - m) @ i.T).sum(axis=1) for o, m, i in zip(self.offsets, self.means, self.inverses, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of 1, x and x x' by class as (label, place, value)."""
    d = len(FEATURES)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x = batch.column(0).flatten().to_numpy().reshape(-1, d)
        y = batch.column(1).to_numpy()
        for label in (0, 1):
            own = x[y == label]
            sums[label] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    label, place = np.indices(sums.shape)
    yield pa.RecordBatch.from_arrays([pa.array(label.ravel().astype(np.int32)), pa.array(place.ravel().astype(np.int32)), pa.array(sums.ravel())], ["label", "place", "value"])


def fit(rows: DataFrame, statistics: str = "statistics", label: str = "label") -> Model:
    """Learn from all rows with label 0 or 1; others are left out."""
    d = len(FEATURES)
    sums = np.zeros((2, 1 + d + d * d))
    used = rows.where(F.col(label).isin(0, 1)).select(statistics, F.col(label).cast("int").alias("label"))
    for row in used.mapInArrow(_moments, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        sums[row.label, row.place] = row.value
    n = sums[:, 0]
    prior = n[1] / n.sum() if n.sum() else 0.5
    if not n.all():
        return Model([], [], [], prior)
    means = [s[1 : 1 + d] / s[0] for s in sums]
    scatter = [s[1 + d :].reshape(d, d) - s[0] * np.outer(m, m) for s, m in zip(sums, means, strict=True)]
    pooled = sum(scatter) / n.sum()
    floor = 1e-6 * max(1.0, np.trace(pooled) / d)
    offsets, inverses = [], []
    for k in (0, 1):
        own = (1 - TO_POOLED) * scatter[k] / n[k] + TO_POOLED * pooled
        own = (1 - TO_DIAGONAL) * own + (TO_DIAGONAL * np.trace(own) / d + floor) * np.eye(d)
        factor = np.linalg.cholesky(own)
        offsets.append(float(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum()))
        inverses.append(np.linalg.inv(factor))
    return Model(offsets, means, inverses, prior)


def score(statistics: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.scores(batch.flatten().to_numpy().reshape(-1, len(FEATURES))))

    return of(statistics)


#: Labels (two numbers each) up to which they are broadcast to the texts; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000


def labelled(rows: DataFrame, labels: DataFrame, train: Column | str, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Training rows with their label; ``train`` is a condition on the key."""
    known = labels.where(train).groupBy(key).agg(F.min(label).alias("label"))
    return rows.select(key, "statistics").join(known, key)


def classify(df: DataFrame, labels: DataFrame, train: Column | str, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(key, score) of every row; the statistics are written once, for learning and for scoring."""
    rows = checkpoint(with_statistics(df.select(key, text), text).select(key, "statistics"))
    model = fit(labelled(rows, labels, train, key, label))
    return rows.select(key, score(F.col("statistics"), model).alias("score"))


def keep_good(df: DataFrame, labels: DataFrame, train: Column | str, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows whose score reaches the threshold, with their columns; learns from the labelled texts alone, then scores each text where it is."""
    known = checkpoint(labels.where(train).groupBy(key).agg(F.min(label).alias("label")))
    small = F.broadcast if known.count() <= BROADCAST_LABELS else (lambda rows: rows)
    model = fit(with_statistics(df.select(key, text).join(small(known), key), text))
    return df.where(score(_statistics(F.col(text)), model) >= threshold)
