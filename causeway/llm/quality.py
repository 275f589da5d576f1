"""Quality classifier: naive Bayes support vectors.

Indicators of byte n-grams and of pairs of word shapes are scaled by their log-count ratios between
the classes; a linear model with hinge loss is fitted on them by dual coordinate descent, and its
margins are calibrated to probabilities on texts that the model didn't see.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm import _labels as L
from causeway.llm import _windows as W

#: Indicators are hashed to this many numbers.
BITS = 16
#: At most about this many labelled rows are fitted on.
SAMPLE = 12_000
GRAMS = (1, 2, 3, 4)
PIECE = 1 << 20
_ODD = np.array([0, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], np.uint32)

# Byte classes for word shapes: 0 other sign, 1 lower, 2 upper, 3 digit, 4 sentence sign, 5 beyond ASCII
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 5
_CLASS[[33, 44, 46, 58, 59, 63]] = 4


def _shapes(data: np.ndarray) -> np.ndarray:
    """Numbers of adjacent words' shapes: first, second and last byte's class, length, and whether the words are equal."""
    starts, ends, _ = W.words(data, np.array([0, len(data)]))
    if not len(starts):
        return np.zeros(0, np.uint32)
    c, n = _CLASS[data], ends - starts
    shape = ((c[starts] * 6 + c[np.minimum(starts + 1, ends - 1)]) * 6 + c[ends - 1]) * 4 + np.minimum(np.log2(n).astype(np.int64), 3)
    h = W.word_hashes(data, starts, ends)
    same = np.r_[False, h[1:] == h[:-1]]
    return ((np.r_[0, shape[:-1]] * 864 + shape) * 2 + same).astype(np.uint32)


def indicators(text: bytes) -> np.ndarray:
    """The numbers of the indicators that a whole text sets, ascending."""
    flags = np.zeros(1 << BITS, bool)
    data = np.frombuffer(text, np.uint8)
    shift = np.uint32(32 - BITS)
    for a in range(0, max(len(data), 1), PIECE):
        piece = data[a : a + PIECE + max(GRAMS) - 1].astype(np.uint32)
        gram = np.zeros(len(piece), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            gram = gram[: len(piece) - n + 1] << np.uint32(8) | piece[n - 1 :]
            if n in GRAMS and len(gram):
                flags[(gram * _ODD[n] + np.uint32(n)) >> shift] = True
    shapes = _shapes(data)
    if len(shapes):
        flags[(shapes * _ODD[5] + np.uint32(5)) >> shift] = True
    return np.flatnonzero(flags)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = np.full((2, 1 << BITS), smooth)
    for row, label in zip(rows, y):
        counts[label, row] += 1
    counts /= counts.sum(1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: float, epochs: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model over rows scaled to unit length; each class has the same cost in all."""
    sign = np.where(y == 1, 1.0, -1.0)
    limit = np.where(y == 1, len(y) / max(2 * (y == 1).sum(), 1), len(y) / max(2 * (y == 0).sum(), 1)) * cost
    # a row's entries are values[row] / length; product is w * values, so that no row is held scaled
    square = values * values
    length = np.array([max(np.sqrt(square[r].sum()), 1e-12) for r in rows])
    diagonal = np.array([square[r].sum() / n**2 + 1.0 for r, n in zip(rows, length)])
    alpha, product, bias = np.zeros(len(y)), np.zeros(len(values)), 0.0
    random = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        most = 0.0
        for i in random.permutation(len(y)):
            r = rows[i]
            gradient = sign[i] * (product[r].sum() / length[i] + bias) - 1
            now = min(max(alpha[i] - gradient / diagonal[i], 0.0), limit[i])
            change = now - alpha[i]
            if change:
                most = max(most, abs(change))
                alpha[i] = now
                product[r] += change * sign[i] / length[i] * square[r]
                bias += change * sign[i]
        if most < 1e-3:
            break
    return np.divide(product, values, out=np.zeros(len(values)), where=values != 0), bias


def _margin(row: np.ndarray, weight: np.ndarray, square: np.ndarray, bias: float) -> float:
    return float(weight[row].sum() / max(np.sqrt(square[row].sum()), 1e-12) + bias)


def fit(texts: list[bytes], y: np.ndarray, cost: float = 10.0) -> bytes:
    rows = [indicators(t).astype(np.int32) for t in texts]
    if len(set(y.tolist())) < 2:
        constant = float(y[0]) if len(y) else 0.5
        return pickle.dumps((np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.clip((constant - 0.5) * 8, -4, 4))))

    def model(part: np.ndarray):
        some = [rows[i] for i in part]
        ratio = log_count_ratios(some, y[part])
        w, bias = dual_coordinate_descent(some, ratio, y[part], cost)
        return (w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias

    fold, margins = L.folds(texts, 3), np.full(len(y), np.nan)
    for k in range(3):
        inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(outside) and len(set(y[inside].tolist())) == 2:
            m = model(inside)
            margins[outside] = [_margin(rows[i], *m) for i in outside]
    seen = ~np.isnan(margins)
    slope, offset = L.logistic(margins[seen, None], y[seen]) if len(set(y[seen].tolist())) == 2 else (1.0, 0.0)
    return pickle.dumps((*model(np.arange(len(y))), float(slope), float(offset)))


def _score(model: bytes):
    loaded: list = []

    def run(texts: pd.Series) -> pd.Series:
        if not loaded:
            loaded.append(pickle.loads(model))
        weight, square, bias, slope, offset = loaded[0]
        margins = np.array([_margin(indicators((t or "").encode()), weight, square, bias) for t in texts], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(slope * margins + offset, -500, 500))))

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", sample: int = SAMPLE) -> bytes:
    """A model of labels[label], from about `sample` labelled documents at most for whose doc_id `train` holds.
    Only texts are inputs. With labels of one class only, every score leans to it; without any it is 0.5."""
    rows = L.labelled_sample(docs, labels, label, train, sample)
    return L.fitted(rows, fit)


def with_quality(docs: DataFrame, model: bytes, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability that a text's label is 1 in a column `name`, which replaces one of that name;
    from whole texts. Null and empty texts have a score too: that of a text that sets no indicator."""
    return docs.withColumn(name, F.pandas_udf(_score(model), "double")(F.col(text_col).cast("string")))
