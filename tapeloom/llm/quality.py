"""Operator 10: quality classifier by naive Bayes support vectors.

Features are indicators of n-grams: words and word pairs, and runs of one to three word shapes (case
pattern, digits, punctuation, repetition of the word before), the latter once for each share of the
text that they reach. A feature's number is the top BITS bits of its hash, so the model has a fixed size; features that share a number
share a weight, which blurs rare ones alone: a number met in fewer than `min_df` examples has none. Indicators are scaled by the class
log-count ratio and a linear hinge-loss model is fitted by dual coordinate descent (each multiplier between 0 and
`cost`); a logistic fit on out-of-fold margins gives the score.

The fit takes at most `max_train` labelled rows; every document is scored on its whole text.
Defined results: a null text is an empty one and is scored by the intercept; repeated rows are scored
alike; without labelled rows every score is 0.5, with one class only it is that class's smoothed share;
an empty table gives an empty result; columns other than doc_id and text play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tapeloom.llm.common import WordCache, held_out, labelled_sample, mix, platt, sigmoid, text_bytes, word_hash

BITS = 20
MAX_TRAIN = 6000
SHARES = (0.0, 1 / 64, 1 / 16, 1 / 8, 1 / 4, 1 / 2)
_SHAPES = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^Aa0])\1+"), rb"\1"))


def shape(word: bytes) -> bytes:
    for pattern, to in _SHAPES:
        word = pattern.sub(to, word)
    return word


def _word(word: bytes) -> int:
    return (word_hash(word.lower()) >> 32) << 32 | word_hash(shape(word)) >> 32


def features(body: bytes, cache: WordCache) -> np.ndarray:
    """Sorted distinct feature ids of one whole text."""
    words = body.split()
    if not words:
        return np.zeros(0, np.uint32)
    both = cache.array(words, np.uint64)
    word, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    form[1:] += (word[1:] == word[:-1]).astype(np.uint64) << np.uint64(33)
    found = [mix(word, np.uint64(1)), mix(word[:-1], word[1:], np.uint64(2))]
    for n in (1, 2, 3):
        if len(form) < n:
            break
        runs, count = np.unique(mix(*(form[i : len(form) - n + 1 + i] for i in range(n))), return_counts=True)
        share = count / (len(form) - n + 1)
        found += [mix(runs[share >= least], np.uint64(10 * n + k)) for k, least in enumerate(SHARES)]
    return np.unique((np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.uint32))


@dataclass
class Model:
    weight: np.ndarray  # 2**BITS floats: a fixed size
    bias: float
    slope: float
    intercept: float

    def margin(self, ids: np.ndarray) -> float:
        return float(self.weight[ids].sum(dtype=np.float64)) + self.bias

    def score(self, ids: np.ndarray) -> float:
        return float(sigmoid(self.slope * self.margin(ids) + self.intercept))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, min_df: int) -> np.ndarray:
    pos, neg = (np.bincount(np.concatenate([r for r, v in zip(rows, y) if v == k] or [np.zeros(0, np.uint32)]), minlength=1 << BITS).astype(float) for k in (1, 0))
    ratio = np.log((pos + 1) / (pos + 1).sum()) - np.log((neg + 1) / (neg + 1).sum())
    return np.where(pos + neg >= min_df, ratio, 0.0)


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int = 7, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """L2-regularised hinge-loss model on indicators times `ratio` and a constant 1, by dual coordinate descent."""
    scaled = [ratio[r] for r in rows]
    sign = np.where(y > 0, 1.0, -1.0)
    norm = np.array([float(v @ v) + 1.0 for v in scaled])
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            r, v, s = rows[i], scaled[i], sign[i]
            grad = s * (float(w[r] @ v) + bias) - 1.0
            new = min(max(alpha[i] - grad / norm[i], 0.0), cost)
            step = (new - alpha[i]) * s
            if step:
                w[r] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < tolerance * cost:
            break
    return w * ratio, bias


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = 0.01, epochs: int = 20, min_df: int = 8, folds: int = 3) -> Model:
    n, pos = len(y), int(np.sum(y))
    if pos in (0, n):
        p = (pos + 1) / (n + 2)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log(p / (1 - p))))

    def one(rows, y):
        return dual_descent(rows, y, log_count_ratio(rows, y, min_df), cost, epochs)

    part, margin = np.arange(n) % folds, np.zeros(n)
    for k in range(folds if min(pos, n - pos) >= folds else 0):
        use = np.flatnonzero(part != k)
        if 0 < y[use].sum() < len(use):
            w, b = one([rows[i] for i in use], y[use])
            for i in np.flatnonzero(part == k):
                margin[i] = w[rows[i]].sum() + b
    w, b = one(rows, y)
    if not margin.any():
        margin = np.array([w[r].sum() + b for r in rows])
    return Model(w.astype(np.float32), b, *platt(margin, y))


def train(docs: DataFrame, labels: DataFrame, train_rows=None, max_train: int = MAX_TRAIN) -> Model:
    """Fits on a bounded sample of labelled rows; `train_rows` is a condition on doc_id."""
    sample = labelled_sample(docs, labels, "quality", F.lit(True) if train_rows is None else train_rows, max_train)

    def extract(batches):
        cache = WordCache(_word)
        for b in batches:
            ids = [features(t, cache).astype(np.int32) for t in b.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "y", "ids"])

    # Kept as flat arrays: a Python number for each feature would take many times the memory.
    found = sample.mapInArrow(extract, "doc_id long, y int, ids array<int>").toArrow().combine_chunks()
    if not found.num_rows:
        return fit([], np.zeros(0, int))
    lists = found.column("ids").chunk(0)
    flat, ends = lists.flatten().to_numpy().view(np.uint32), np.diff(lists.offsets.to_numpy()).cumsum()
    rows = [flat[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())]
    doc_ids, y = found.column("doc_id").to_pylist(), found.column("y").to_numpy()
    order = sorted(range(len(rows)), key=lambda i: (word_hash(str(doc_ids[i]).encode()), rows[i].tobytes()))
    return fit([rows[i] for i in order], y[order].astype(int))


def scorer(docs: DataFrame, model: Model):
    """A column function: whole text (binary) -> score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache, m = WordCache(_word), shared.value
        for bodies in batches:
            yield pd.Series([m.score(features(t, cache)) for t in bodies], dtype="float64")

    return score


def score_documents(docs: DataFrame, labels: DataFrame, train_rows=None, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id and score of every document."""
    model = train(docs, labels, train_rows, max_train)
    return docs.select("doc_id", scorer(docs, model)(text_bytes()).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_documents(docs, labels, ~held_out(5, 0))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
