"""Operators 3 and 10 against plain versions of their definitions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import quality, toxicity
from tapeloom.llm.common import WordCache, held_out, labelled_sample, platt
from tests.llm.test_llm import DOCS, docs, labels, words


def test_sample_bounds_rows_whatever_the_ids(spark):
    rows = [(7, f"text {k}") for k in range(5000)] + [(8, "other"), (9, None), (None, "x")]
    y = labels(spark, [(7, 1, 0), (7, 0, 1), (8, 1, 1), (9, 0, 0), (None, 1, 1), (99, 1, 1)])
    got = labelled_sample(docs(spark, rows), y, "quality", F.lit(True), 100).collect()
    assert sorted((r["doc_id"], r["y"]) for r in got) == [(7, 1), (8, 1), (9, 0)]
    assert bytes(next(r["body"] for r in got if r["doc_id"] == 7)).startswith(b"text ")
    assert labelled_sample(docs(spark, rows), y, "quality", F.lit(True), 1).count() <= 1
    again = labelled_sample(docs(spark, rows[::-1]), y, "quality", F.lit(True), 100).collect()
    assert {(r["doc_id"], bytes(r["body"])) for r in again} == {(r["doc_id"], bytes(r["body"])) for r in got}


# -- quality ------------------------------------------------------------------------------------------------------
def test_shapes_are_whole_words():
    assert quality.shape(b"a1B" * 40) == b"a0A" * 40 and quality.shape(b"aaaBBB111!!!") == b"aA0!"
    assert quality._word(b"a1B" * 40) != quality._word(b"a1B" * 40 + b"!")


def test_log_count_ratio_against_plain_counts():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 9)).astype(np.uint32) for _ in range(80)]
    y = rng.integers(0, 2, 80)
    got = quality.log_count_ratio(rows, y, 5)
    size = 1 << quality.BITS
    count = {k: Counter(f for r, v in zip(rows, y) if v == k for f in r.tolist()) for k in (0, 1)}
    total = {k: sum(count[k].values()) + size for k in (0, 1)}
    for f in range(40):
        want = math.log((count[1][f] + 1) / total[1]) - math.log((count[0][f] + 1) / total[0]) if count[0][f] + count[1][f] >= 5 else 0.0
        assert got[f] == pytest.approx(want)


def test_dual_descent_against_projected_gradient():
    """The same box-constrained dual, solved by small steps along the gradient on dense matrices."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 25, 6)).astype(np.uint32) for _ in range(60)]
    y = np.array([int(3 in r or (5 in r and 9 not in r)) for r in rows])
    ratio, cost = rng.normal(size=25), 0.3
    w, bias = quality.dual_descent(rows, y, ratio, cost, 3000, tolerance=1e-7)
    x = np.zeros((60, 26))
    for i, r in enumerate(rows):
        x[i, r], x[i, 25] = ratio[r], 1.0
    signed = x * np.where(y > 0, 1.0, -1.0)[:, None]
    gram, alpha = signed @ signed.T, np.zeros(60)
    for _ in range(60_000):
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, cost)
    want = signed.T @ alpha
    assert w == pytest.approx(want[:25] * ratio, abs=2e-3) and bias == pytest.approx(want[25], abs=2e-3)
    hinge = lambda v: 0.5 * v @ v + cost * np.maximum(0, 1 - signed @ v).sum()
    assert hinge(want) == pytest.approx(alpha.sum() - 0.5 * alpha @ gram @ alpha, rel=1e-3)  # no gap between the two problems


def test_quality_scores_against_plain_sums(spark):
    rows = [(k, words(30, seed=k) if k % 3 else " ".join(["WIN", "NOW!!"] * 9 + words(9, seed=k).split())) for k in range(90)] + [(400, None), (401, "")]
    y = labels(spark, [(k, int(k % 3 > 0), 0) for k in range(90)])
    d = docs(spark, rows)
    model = quality.train(d, y, ~held_out(5, 0))
    cache = WordCache(quality._word)
    for r in quality.score_documents(d, y, ~held_out(5, 0)).collect():
        ids = quality.features((dict(rows)[r["doc_id"]] or "").encode(), cache)
        want = 1 / (1 + math.exp(-(model.slope * (sum(float(model.weight[i]) for i in ids) + model.bias) + model.intercept)))
        assert r["score"] == pytest.approx(want, abs=1e-9)


# -- toxicity -----------------------------------------------------------------------------------------------------
def plain_terms(text):
    return Counter(t for t in (re.sub(r"^\W+|\W+$", "", w).lower() for w in re.split(r"[\x20\x09-\x0D]+", text or "")) if t)


def test_terms_of_ascii_and_other_words():
    for w in ("It's", "'quoted'", "a_b_", "--", "Élan!", "x’y", "§§", "ÄÖ,", "_", "12%"):
        assert toxicity.term_of(w.encode()).decode() == re.sub(r"^\W+|\W+$", "", w).lower()


def plain_scores(all_texts, train):
    """Scores by the operator's definition, with dictionaries and every pair of a document and an example."""
    n_docs, df = len(all_texts), Counter(t for x in all_texts for t in plain_terms(x))

    def weights(examples):
        n, p = len(examples), sum(y for _, y, _ in examples)
        c, a = Counter(), Counter()
        for _, y, x in examples:
            c.update(set(x))
            a.update(set(x) if y else ())
        cell = lambda s, r, k: s * math.log(s * n / (r * k)) if s else 0.0
        known = {t: 2 * (cell(a[t], c[t], p) + cell(c[t] - a[t], c[t], n - p) + cell(p - a[t], n - c[t], p) + cell(n - p - c[t] + a[t], n - c[t], n - p)) for t in c}
        return lambda t: (math.log((1 + n_docs) / (1 + df[t])) + 1e-6) * (toxicity.FLOOR + max(known.get(t, 0.0), 0.0))

    def vector(x, weight, vocabulary):
        v = {t: (1 + math.log(n)) * weight(t) for t, n in x.items() if t in vocabulary}
        size = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / size for t, w in v.items()}

    def model(examples, vocabulary):
        weight = weights(examples)
        merged = defaultdict(list)
        for i, y, x in examples:
            if x:
                merged[y, tuple(sorted(x.items()))].append(i)
        lists = [(min(ids), y, len(ids), vector(Counter(dict(x)), weight, vocabulary)) for (y, x), ids in merged.items()]
        prior = (sum(y for _, y, _ in examples) + 1) / (len(examples) + 2)

        def vote(x):
            v = vector(x, weight, vocabulary)
            near = sorted((-round(sum(w * e[3].get(t, 0.0) for t, w in v.items()), 12), *e[:3]) for e in lists)
            near = [(-c, i, y, n) for c, i, y, n in near if c < 0][: toxicity.K]
            yes, no = toxicity.PRIOR * prior, toxicity.PRIOR * (1 - prior)
            for c, _, y, n in near:
                w = c / (1 - min(c, 1) + toxicity.SOFT) * (1 + math.log(n))
                yes, no = yes + w * y, no + w * (1 - y)
            return math.log(yes / no), [i for _, i, _, _ in near]

        return vote

    examples = sorted(((i, y, plain_terms(x)) for i, y, x in train), key=lambda e: (toxicity.word_hash(str(e[0]).encode()), e[0]))
    vocabulary = {t for _, _, x in examples for t in x}
    votes, ys = [], []
    for fold in range(toxicity.FOLDS):
        trial = model([e for k, e in enumerate(examples) if k % toxicity.FOLDS != fold], vocabulary)
        for e in examples[fold :: toxicity.FOLDS]:
            votes.append(trial(e[2])[0])
            ys.append(e[1])
    slope, intercept = platt(np.array(votes), np.array(ys))
    final = model(examples, vocabulary)
    out = {}
    for x in set(all_texts):
        v, near = final(plain_terms(x))
        out[x] = (1 / (1 + math.exp(-max(-30, min(30, slope * v + intercept)))), near)
    return out


def test_toxicity_end_to_end_against_all_pairs(spark):
    bad = ["nasty", "vileness", "grotty"]
    rows = [(100 + k, words(25, seed=k, size=9) + (f" {bad[k % 3]}, " * 2 if k % 5 == 0 else "") + (" Émile!" if k % 7 == 0 else "")) for k in range(150)]
    rows += [(300, rows[3][1]), (301, rows[5][1]), (302, None), (303, ""), (304, "nothing known héré"), (305, "nasty"), (305, "nasty")]
    y = [(i, 1, int((i - 100) % 5 == 0)) for i, _ in rows if i < 302]
    train = [(i, t, dict(rows)[i]) for i, _, t in y if zlib.crc32(str(i).encode()) % 4 != 2]
    want = plain_scores([t for _, t in rows], train)
    got = toxicity.score_documents(spark.createDataFrame([(i, t, "en", "s", 0, 1.0, "x", 7, 8, True) for i, t in rows], DOCS), labels(spark, y), ~held_out(4, 2)).collect()
    assert len(got) == len(rows)
    for r in got:
        score, near = want[dict(rows)[r["doc_id"]]]
        assert r["score"] == pytest.approx(score, abs=1e-6) and r["neighbours"] == near
