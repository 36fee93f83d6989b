"""Cases that grow: repeated lines, earlier quotes, neighbours by the shipped parameters."""

import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import linededup, pivots
from tests.llm.test_llm import docs, vectors, words


def test_line_dedup_is_linear_in_repeated_lines(spark):
    rows = [(1, "\n".join(["one two three"] * 20_000)), (2, "\n".join(["one two three"] * 30)), (3, "\n".join(f"line {k} of many" for k in range(20_000)))]
    began = time.time()
    got = {r["doc_id"]: r for r in linededup.deduplicated(docs(spark, rows)).collect()}
    # The run of 17 lines from line 0 on stands first; from line 1 on it is a later one, so all lines but line 0 go.
    assert got[1]["n_removed"] == 20_000 - 1 and got[1]["clean_text"] == "one two three"
    assert got[2]["n_removed"] == 30 and got[2]["clean_text"] == "" and got[3]["n_removed"] == 0
    assert time.time() - began < 240


def test_line_dedup_after_earlier_quotes(spark):
    """Passages that stand twice, and one earlier document that quotes a part of each."""
    passages = ["\n".join(words(10, seed=1000 * k + j) for j in range(5)) for k in range(40)]
    quotes = "\n".join("\n".join(p.split("\n")[:3]) for p in passages)
    rows = [(1, "\n\n".join("\n".join(p.split("\n")[:3] + [f"apart {k}"]) for k, p in enumerate(passages)))]
    rows += [(100 + k, f"{words(4, seed=k)}\n{p}") for k, p in enumerate(passages)] + [(200 + k, f"{p}\n{words(4, seed=500 + k)}") for k, p in enumerate(passages)]
    assert quotes
    got = {r["doc_id"]: r["n_removed"] for r in linededup.deduplicated(docs(spark, rows)).collect()}
    assert all(got[100 + k] == 0 and got[200 + k] == 5 for k in range(40)) and got[1] == 0


def brute_neighbours(x, ids, k=5):
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = y @ y[q]
        s[ids == ids[q]] = -2
        out[int(ids[q])] = set(ids[np.lexsort((ids, -s.round(12)))[:k]].tolist())
    return out


@pytest.mark.parametrize("dims", [64, 128])
def test_neighbours_recall_of_the_shipped_parameters(spark, dims):
    """Random vectors, the hardest kind, in more than one block."""
    x = np.random.default_rng(dims).normal(size=(20_000, dims)).astype(np.float32)
    ids = np.arange(len(x))
    got = defaultdict(list)
    for r in pivots.neighbours(vectors(spark, zip(ids.tolist(), x.tolist())), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    want = brute_neighbours(x, ids)
    assert set(got) == set(want) and all(len(v) == len(set(v)) == 5 for v in got.values())
    recall = sum(len(set(got[q]) & want[q]) for q in want) / (5 * len(want))
    print(f"recall of {dims} dimensions: {recall:.3f}")
    assert recall >= 0.9


def test_repeated_query_rows_answer_once(spark):
    rows = [(50, [0.0, 1.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [1.0, 1.0]), (4, [0.0, 2.0]), (4, [0.0, 2.0]), (100, [0.0, 1.0])]
    got = defaultdict(list)
    for r in pivots.neighbours(vectors(spark, rows), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], round(r["score"], 6)))
    assert got[50] == [(1, 4, 1.0), (2, 4, 1.0), (3, 100, 1.0), (4, 3, 0.707107)]
    assert got[100] == [(1, 4, 1.0), (2, 4, 1.0), (3, 50, 1.0), (4, 3, 0.707107), (5, 50, 0.0)]
