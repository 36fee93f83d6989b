"""A model part takes few bytes a run, and a worker holds none when its task is over."""

import sys
import tracemalloc

import numpy as np
import pyarrow as pa

from tapeloom.llm import ppm


def _model(runs, order=5):
    keys, n = np.unique(runs, return_counts=True)
    pairs, pair_n = np.unique(runs & np.uint64(0xFFFF), return_counts=True)
    return ppm.Model(order, keys, n.astype(np.int64), pairs, pair_n.astype(np.int64))


def test_a_part_is_small():
    rng = np.random.default_rng(3)
    text = bytes(rng.choice(np.frombuffer(b"etaoinshrdlu ", np.uint8), 400_000).tobytes())
    runs, _ = ppm.byte_runs([text], 5)
    model = _model(runs)
    size = sum(a.nbytes for level in model.levels[:-1] for a in vars(level).values()) + sum(a.nbytes for k, a in vars(model.levels[-1]).items() if k != "count") + model.cost.nbytes
    rows = sum(len(level.grams) + len(level.contexts) for level in model.levels)
    assert size < 18 * rows
    assert np.isfinite(model.log10(runs)).all()


def test_nothing_is_held_after_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one text and one more"), (2, "another text")], "doc_id long, text string")
    trained = ppm.train(docs)

    class Frame:  # takes the task's function, to run it here
        def select(self, *_):
            return self

        def mapInArrow(self, run, _schema):
            return run

    run = ppm.score_documents(Frame(), trained)
    rows = run(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "body": [b"one text", b"another"]})]))
    assert next(rows).num_rows == 2 and ppm._held
    assert list(rows) == [] and not ppm._held
    assert sys.getsizeof(ppm._held) < 1000


def test_a_chunk_takes_few_bytes_a_byte(monkeypatch):
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, w)).encode() for w in rng.integers(97, 123, (3000, 6))]
    bodies = [b" ".join(words[i] for i in rng.integers(0, 3000, 1500)) for _ in range(800)]
    models = [_model(ppm.byte_runs(bodies[:20], 5)[0])] * 8
    counts = np.sort(np.array([ppm.word_hash(w) for w in words], np.uint64).view(np.int64)), np.ones(3000, np.int64)
    monkeypatch.setattr(ppm, "_part", lambda trained, kind, part: counts if kind == ppm.WORDS else models[part])

    class Frame:  # takes the task's function, to run it here
        def select(self, *_):
            return self

        def mapInArrow(self, run, _schema):
            return run

    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(bodies)), "body": bodies})
    tracemalloc.start()
    got = list(ppm.score_documents(Frame(), ppm.Trained(5, "", (8, 1), 100, 3000))(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in got) == 800 and sum(map(len, bodies)) > 8 << 20
    assert peak < 8 * (8 << 20) + (48 << 20)
