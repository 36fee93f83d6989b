"""Operator 3: toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are lower-cased words without outer punctuation, and every term of every labelled example is indexed. A term's weight is
(1 + ln tf) * ln((1 + N) / (1 + df)) * contrast, with document frequencies over all documents; contrast is FLOOR and the log-likelihood ratio of
the term and the label among the examples, so words that tell the labels apart weigh most and none is left out. Vectors have length 1.

The examples' vectors lie in inverted lists cut into blocks of BLOCK examples, and each list keeps its largest weight in each block it reaches.
A document's terms with long lists and little weight, as far as they can add SLACK to a cosine, are only bounded by these block maxima; the lists
of the others are added up. Examples that reach the K-th sum with their block's bound are then scored in full, so the
neighbours are exact; equal cosines go to the smaller doc_id. Examples that lean on the same word lie together, which keeps the bounds of other
blocks low. Equal vectors of the same label are one example with a count.
Votes are weighted by the angle, cosine / (1 - cosine + SOFT), against a prior of weight PRIOR for the label's share; a
logistic fit calibrates them on each fold of the examples, with lists and contrasts that know the other folds alone.

The fit takes at most `max_examples` labelled rows, so the index that is broadcast is bounded by their terms; every document is
scored on its whole text. Defined results: null and empty texts, and texts without a term of any example, get the
score of an empty vote; repeated rows are scored alike; without labelled rows every score is 0, with one class it is that class's
smoothed share; an empty table gives an empty result; columns other than doc_id and text play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tapeloom.llm.common import WordCache, held_out, labelled_sample, platt, sigmoid, text_bytes, word_hash

MAX_EXAMPLES = 5000
K, BLOCK, SLACK, SOFT, PRIOR, FLOOR, FOLDS = 16, 64, 0.02, 0.1, 0.5, 0.05, 3
_OUTER = re.compile(r"^\W+|\W+$")
_ASCII_OUTER = bytes(b for b in range(128) if not (chr(b).isalnum() or b == ord("_")))


def term_of(word: bytes) -> bytes:
    """The term of a white-space word; empty if it has none."""
    if word.isalpha():
        return word.lower()
    if word.isascii():
        return word.strip(_ASCII_OUTER).lower()
    text = word.decode("utf-8", "replace")
    if text.isalpha():
        return text.lower().encode()
    return _OUTER.sub("", word.decode("utf-8", "replace")).lower().encode()


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all half-open ranges in turn, and which range each comes from."""
    size = ends - starts
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(of) else of, of


# -- index ----------------------------------------------------------------------------------------------------
@dataclass
class Index:
    """Block-max inverted index over the examples' vectors; `idf` has the weight of each term, its contrast included."""

    terms: dict[bytes, int]
    idf: np.ndarray
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # smallest doc_id of equal examples
    label: np.ndarray = field(default_factory=lambda: np.zeros(0))
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    row: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # postings by term, then example
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    runs: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # where each term's runs start: its postings in one block
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # a run's block, largest weight and first posting
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    top: np.ndarray = field(default_factory=lambda: np.zeros(0))  # a term's largest weight
    example: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # where each example's terms start
    own: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    own_weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: float = 0.5
    slope: float = 1.0
    intercept: float = 0.0
    constant: float | None = None  # the score of every text where there is nothing to learn from

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """vectors: terms and weights of each example, in the order of ids."""
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)])
        row = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        self.example = np.searchsorted(row, np.arange(len(vectors) + 1))
        self.own, self.own_weight = term.astype(np.int32), weight
        order = np.lexsort((row, term))
        term, self.row, self.weight = term[order], row[order].astype(np.int32), weight[order]
        block = self.row // BLOCK
        starts = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, int)
        self.block, self.first = block[starts], np.append(starts, len(term))
        self.most = np.maximum.reduceat(self.weight, starts) if len(starts) else np.zeros(0)
        self.runs = np.searchsorted(term[starts], np.arange(len(self.idf) + 1))
        self.top = np.zeros(len(self.idf))
        np.maximum.at(self.top, term[starts], self.most)

    def vector(self, found: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Terms, ascending, and weights of length 1."""
        term = np.array(sorted(found), np.int64)
        return self.scaled(term, np.array([found[t] for t in term.tolist()], float))

    def scaled(self, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 + np.log(tf)) * self.idf[term]
        return term, weight / np.sqrt((weight * weight).sum()) if len(weight) else weight

    def _sums(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of all examples, what these terms add to the cosine."""
        at, of = _spans(self.first[self.runs[term]], self.first[self.runs[term + 1]])
        return np.bincount(self.row[at], self.weight[at] * weight[of], len(self.ids))

    def _cosines(self, examples: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of some examples, by their own terms; a scratch row as long as the vocabulary is kept clear between calls."""
        scratch = self.__dict__.setdefault("_scratch", np.zeros(len(self.idf)))
        scratch[term] = weight
        at, of = _spans(self.example[examples], self.example[examples + 1])
        out = np.bincount(of, self.own_weight[at] * scratch[self.own[at]], len(examples))
        scratch[term] = 0.0
        return out

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int = K, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a positive cosine, exactly; one copy of `skip` is left out."""
        if not len(term) or not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0)
        most = weight * self.top[term]
        order = np.argsort(most / np.maximum(1, self.first[self.runs[term + 1]] - self.first[self.runs[term]]))
        light = np.zeros(len(term), bool)
        light[order[: np.searchsorted(np.cumsum(most[order]), SLACK)]] = True
        sums = self._sums(term[~light], weight[~light])
        runs, of = _spans(self.runs[term[light]], self.runs[term[light] + 1])
        bound = np.bincount(self.block[runs], self.most[runs] * weight[light][of], -(-len(self.ids) // BLOCK))
        upper = sums + np.repeat(bound, BLOCK)[: len(sums)]
        if skip >= 0 and self.count[skip] < 2:
            sums[skip] = upper[skip] = 0.0
        least = np.partition(sums, len(sums) - k)[len(sums) - k] if len(sums) > k else 0.0
        at = np.flatnonzero((upper > 0) & (upper >= least - 1e-9))
        cos = (self._cosines(at, term, weight) if len(at) * 8 < len(sums) else self._sums(term, weight)[at]).round(12)
        at, cos = at[cos > 0], cos[cos > 0]
        best = np.lexsort((self.ids[at], -cos))[:k]
        return at[best], cos[best]

    def vote(self, at: np.ndarray, cos: np.ndarray, skip: int = -1) -> float:
        """Log odds of the weighted votes; the count of an example's copies counts as its logarithm."""
        weight = cos / (1 - np.minimum(cos, 1.0) + SOFT) * (1 + np.log(np.maximum(1, self.count[at] - (at == skip))))
        yes = float((weight * self.label[at]).sum()) + PRIOR * self.prior
        no = float((weight * (1 - self.label[at])).sum()) + PRIOR * (1 - self.prior)
        return float(np.log(yes / no))

    def score(self, term: np.ndarray, tf: np.ndarray) -> tuple[float, list[int], list[float]]:
        if self.constant is not None:
            return self.constant, [], []
        at, cos = self.nearest(*self.scaled(term, tf))
        return float(sigmoid(self.slope * self.vote(at, cos) + self.intercept)), self.ids[at].tolist(), cos.tolist()


class Finder:
    """Terms, ascending, of a text that are in the vocabulary, and how often each stands there."""

    def __init__(self, terms: dict[bytes, int]):
        known = terms.get
        self.words = WordCache(lambda w: known(w.lower() if w.isalpha() else term_of(w), -1))

    def __call__(self, body: bytes) -> tuple[np.ndarray, np.ndarray]:
        term, tf = np.unique(self.words.array(body.split(), np.int64), return_counts=True)
        return (term[1:], tf[1:]) if len(term) and term[0] < 0 else (term, tf)


# -- fitting --------------------------------------------------------------------------------------------------
def fit(docs: DataFrame, labels: DataFrame, train_rows=None, max_examples: int = MAX_EXAMPLES) -> Index:
    """Index of a bounded sample of labelled rows; `train_rows` is a condition on doc_id."""
    sample = labelled_sample(docs, labels, "toxic", F.lit(True) if train_rows is None else train_rows, max_examples)

    def terms(batches):
        cache = WordCache(term_of)
        for b in batches:
            found = [Counter(filter(None, map(cache.__getitem__, body.split()))) for body in b.column("body").to_pylist()]
            lists = [pa.array([list(f) for f in found], pa.list_(pa.binary())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *lists], ["doc_id", "y", "terms", "tf"])

    # max_examples rows; kept as flat arrays, with a number for each term.
    got = sample.mapInArrow(terms, "doc_id long, y int, terms array<binary>, tf array<int>").toArrow().combine_chunks()
    y = got.column("y").to_numpy().astype(int)
    if not len(y) or y.min() == y.max():
        share = 0.0 if not len(y) else float((y.sum() + 1) / (len(y) + 2))
        return Index({}, np.zeros(0), constant=share)
    lists = got.column("terms").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    vocabulary = {names[o]: i for i, o in enumerate(order)}
    flat, tf = place[coded.indices.to_numpy()], got.column("tf").combine_chunks().flatten().to_numpy()
    ends = np.diff(lists.offsets.to_numpy()).cumsum().tolist()
    rows = []
    for doc_id, label, s, e in zip(got.column("doc_id").to_pylist(), y.tolist(), [0, *ends[:-1]], ends):
        up = np.argsort(flat[s:e])
        rows.append((doc_id, label, flat[s:e][up], tf[s:e][up].astype(float)))
    rows.sort(key=lambda r: (word_hash(str(r[0]).encode()), r[0]))
    return _fitted(vocabulary, _idf(docs, vocabulary), rows)


def _idf(docs: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """From the document frequencies over all rows; a task adds up its own, so it sends at most a number a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        find, df, n = Finder(shared.value), np.zeros(len(shared.value) + 1, np.int64), 0
        for b in batches:
            n += b.num_rows
            for body in b.column("body").to_pylist():
                df[find(body)[0]] += 1
        df[-1] = n
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    summed = docs.select(text_bytes().alias("body")).mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(vocabulary) + 1, np.int64)
    df[summed.column("term").to_numpy()] = summed.column("df").to_numpy()
    shared.unpersist()
    return np.log((1 + df[-1]) / (1 + df[:-1])) + 1e-6


def contrast(rows: list[tuple], n_terms: int) -> np.ndarray:
    """FLOOR and the log-likelihood ratio of each term's presence and the label."""
    y = np.array([r[1] for r in rows], float)
    term = np.concatenate([r[2] for r in rows])
    c = np.bincount(term, minlength=n_terms).astype(float)
    a = np.bincount(term, np.repeat(y, [len(r[2]) for r in rows]), n_terms)
    n, p = float(len(y)), float(y.sum())

    def cell(seen, of_term, of_label):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) * n / np.maximum(of_term * of_label, 1e-300)), 0.0)

    ratio = 2 * (cell(a, c, p) + cell(c - a, c, n - p) + cell(p - a, n - c, p) + cell(n - p - c + a, n - c, n - p))
    return FLOOR + np.maximum(ratio, 0.0)


def _fitted(vocabulary: dict[bytes, int], idf: np.ndarray, rows: list[tuple]) -> Index:
    """rows: doc_id, label, terms (ascending) and their counts. Calibrates on each fold of the rows with an index of the others."""
    index = Index(vocabulary, idf * contrast(rows, len(idf)))
    votes, labels = [], []
    for fold in range(FOLDS):
        apart, others = rows[fold::FOLDS], [r for k, r in enumerate(rows) if k % FOLDS != fold]
        if len({r[1] for r in others}) == 2:
            trial = Index(vocabulary, idf * contrast(others, len(idf)))
            _lists(trial, others)
            votes += [trial.vote(*trial.nearest(*trial.scaled(*r[2:]))) for r in apart]
            labels += [r[1] for r in apart]
    if len(set(labels)) == 2:
        slope, intercept = platt(np.array(votes), np.array(labels))
        if slope > 0:
            index.slope, index.intercept = slope, intercept
    _lists(index, rows)
    return index


def _lists(index: Index, rows: list[tuple]) -> None:
    """Merges equal examples and builds the lists; examples with the same heaviest term lie side by side."""
    merged: dict[tuple, list] = {}
    y = [r[1] for r in rows]
    index.prior = (sum(y) + 1) / (len(y) + 2)
    for doc_id, label, term, tf in rows:
        if len(term):
            one = merged.setdefault((label, term.tobytes(), tf.tobytes()), [doc_id, label, index.scaled(term, tf), 0])
            one[0], one[3] = min(one[0], doc_id), one[3] + 1
    examples = sorted(merged.values(), key=lambda e: (int(e[2][0][np.argmax(e[2][1])]), e[0], e[1]))
    index.ids = np.array([e[0] for e in examples], np.int64)
    index.label = np.array([e[1] for e in examples], float)
    index.count = np.array([e[3] for e in examples], np.int64)
    index.build([e[2] for e in examples])


def _fill(index: Index, rows: list[tuple[int, int, Counter]]) -> None:
    """Lists of counted terms in place of `_fitted`, with the weights that the index has."""
    _lists(index, [(i, y, np.array(sorted(c), np.int64), np.array([c[t] for t in sorted(c)], float)) for i, y, c in rows])


# -- scoring --------------------------------------------------------------------------------------------------
def scorer(docs: DataFrame, index: Index):
    """A column function: whole text (binary) -> struct of score, neighbours and cosines."""
    index.__dict__.pop("_scratch", None)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("score double, neighbours array<long>, cosines array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = shared.value
        find, known = Finder(index.terms), WordCache(lambda key: None, 20_000)
        for bodies in batches:
            out = []
            for body in bodies:
                key = xxhash.xxh3_128_digest(body)  # copies are scored once
                found = known[key]
                if found is None:
                    found = known[key] = index.score(*find(body))
                out.append(found)
            yield pd.DataFrame(out, columns=["score", "neighbours", "cosines"])

    return score


def score_documents(docs: DataFrame, labels: DataFrame, train_rows=None, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """doc_id, score and the evidence: ids and cosines of the examples that voted."""
    judged = docs.select("doc_id", scorer(docs, fit(docs, labels, train_rows, max_examples))(text_bytes()).alias("s"))
    return judged.select("doc_id", "s.score", "s.neighbours", "s.cosines")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_documents(docs, labels, ~held_out(4, 2))
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "neighbours", "cosines")
