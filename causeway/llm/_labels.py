"""Bounded samples of labelled rows, models fitted on one executor, and calibration."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm import _windows as W
from causeway.llm._common import gathered, lean


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of about `bound` labelled documents at most, chosen by a hash of the id among those
    for which `train`, a condition on column doc_id, holds. A label other than 0 or 1 is none; of labels
    that contradict each other the least counts."""
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    y = y.where(train).groupBy("doc_id").agg(F.min("y").alias("y"))
    n = y.count()
    if n > bound:
        y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return d.join(F.broadcast(y), F.col("_id") == F.col("doc_id")).select("doc_id", "text", "y")


def fitted(sample: DataFrame, fit: Callable[[list[bytes], np.ndarray], bytes]) -> bytes:
    """What fit(texts, labels) returns, from one task on an executor; texts come in a fixed order."""

    def run(batches):
        t = gathered(batches, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("y", pa.int32())])).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        texts = [x.as_py().encode() for chunk in t.column("text").chunks for x in chunk]
        yield pa.RecordBatch.from_arrays([pa.array([fit(texts, t.column("y").to_numpy().astype(np.int64))], pa.binary())], names=["model"])

    model = sample.repartition(1).mapInArrow(lean(run), "model binary").first()
    return bytes(model[0]) if model is not None else fit([], np.zeros(0, np.int64))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression with a bias as its last column, by Newton's method; smoothed
    targets (Platt) keep it finite where classes can be told apart."""
    x = np.c_[x, np.ones(len(x))]
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    loss = lambda w: np.logaddexp(0, x @ w).sum() - t @ (x @ w) + w @ keep @ w / 2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - t) + keep @ w
        step = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-9)[:, None]) + keep, g)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def folds(texts: list[bytes], parts: int = 4, words: int = 5) -> np.ndarray:
    """A fold for each text, by the least hash among its shingles of some words, so equal texts share one, and near copies
    do as often as their shingles are the same: copies don't vouch for each other. What texts begin with is no matter."""
    out = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = W.words(data, np.array([0, len(data)]))
        h = W.word_hashes(data, starts, ends, lower=True)
        if len(h):
            out[i] = int(W.grams(h, min(words, len(h))).min()) % 1_000_003 % parts
    return out
