"""Quality classifier: Bradley-Terry ranking learned from preference pairs.

Each labelled good document is preferred to each labelled bad one; pairs are drawn with a
fixed seed, and the weights minimise the logistic loss on differences of their features.
A quantile of the training scores becomes the threshold, placed at 0.7 of the final scale.
"""

import math
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, labelled_sample

#: Labelled rows that a fit looks at: half of each class, by hash order.
FIT_ROWS = 12_000
PAIRS = 60_000
THRESHOLD = 0.7

FEATURES = ("symbols", "exclamations", "upper", "digits", "stutter", "repeated_words", "repeated_lines", "word_length", "no_letters", "no_words")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~[]"]] = True
_UPPER, _LOWER, _DIGITS = (np.isin(np.arange(256), list(map(ord, s))) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"))


def features(text: str | None) -> list[float]:
    """Shares in [0, 1] of a whole text, as square roots so that a spoilt part of a text shows.

    Symbols other than sentence marks, exclamation marks and digits among bytes; capitals among
    ASCII letters; words that repeat the one before; the distance from all words being distinct, on
    a log scale; lines that repeat another; word length; words without a letter; texts without words.
    """
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * 9 + [1.0]
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n, m = int(counts.sum()), len(words)
    upper, lower = int(counts[_UPPER].sum()), int(counts[_LOWER].sum())
    lines = [x for x in text.split("\n") if x]
    shares = (
        counts[_SYMBOLS].sum() / n,
        counts[33] / n,
        upper / max(1, upper + lower),
        counts[_DIGITS].sum() / n,
        sum(map(operator.eq, words, words[1:])) / m,
        max(0.0, 1 - math.log1p(len(set(words))) / math.log1p(m)),
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, n / m / 40),
        sum(not _LETTER.search(w) for w in words) / m,
        0.0,
    )
    return [math.sqrt(x) for x in shares]


_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        raw = ((x - self.mean) / self.scale) @ self.weights
        return _sigmoid(self.slope * (raw - self.cut) + math.log(THRESHOLD / (1 - THRESHOLD)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 11) -> QualityModel:
    """Bradley-Terry weights, threshold quantile and scale from features and 0/1 labels.

    With one class only, or no rows, there are no pairs: all scores are then the share of
    label 1, or 1 without rows, so that nothing is rejected unheard.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        zero = np.zeros(x.shape[1])
        return QualityModel(zero, zero + 1, zero, 0.0, 1.0, float(y.mean()) if len(y) else 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps on mean log(1 + exp(-w d)) + ridge / 2 * |w|^2
        p = _sigmoid(-(d @ w))
        gradient = -(p[:, None] * d).mean(0) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    raw = z @ w
    # Every quantile of the training scores is tried; the one of the best balanced accuracy is the cut.
    order = np.argsort(raw, kind="stable")
    ranked, labels = raw[order], y[order]
    accuracy = 0.5 * (np.concatenate([[0], np.cumsum(labels == 0)]) / len(bad) + 1 - np.concatenate([[0], np.cumsum(labels == 1)]) / len(good))
    accuracy[1:-1][ranked[1:] == ranked[:-1]] = -1  # equal scores can't be told apart
    k = int(np.argmax(accuracy))
    edges = np.concatenate([[ranked[0] - 1], ranked, [ranked[-1] + 1]])
    cut = float((edges[k] + edges[k + 1]) / 2)
    slope = 1.0
    for _ in range(30):  # one-parameter logistic regression with the cut held at THRESHOLD
        p = _sigmoid(slope * (raw - cut) + math.log(THRESHOLD / (1 - THRESHOLD)))
        g = ((p - y) * (raw - cut)).mean() + 1e-3 * slope
        h = (p * (1 - p) * (raw - cut) ** 2).mean() + 1e-3
        slope = float(np.clip(slope - g / h, 0.05, 20.0))
    return QualityModel(mean, scale, w, cut, slope)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> QualityModel:
    """Fit on at most ``limit`` labelled rows (see labelled_sample); only their features reach the driver."""
    sample = labelled_sample(docs, labels, "quality", limit)
    rows = sample.mapInArrow(_feature_rows, "doc_id long, y int, x array<double>").collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit_pairs(x, np.array([r["y"] for r in rows], float))


def classify(docs: DataFrame, model: QualityModel, score: str = "score") -> DataFrame:
    """``docs`` with a double column ``score`` in [0, 1] that replaces one of that name; no shuffle.

    Null texts count as empty, and an empty text has a score like any other; repeated rows
    get equal scores; an empty table stays empty.
    """
    kept = [c for c in docs.columns if c != score]

    @F.pandas_udf(T.DoubleType())
    def scored(text: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in text], float).reshape(len(text), len(FEATURES))
        return pd.Series(model.scores(x))

    return docs.select(*[F.col(f"`{c}`") for c in kept], scored(F.col("text")).alias(score))


def quality(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 where score >= 0.7)."""
    out = classify(docs.select("doc_id", "text"), fit(docs, labels, limit))
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
