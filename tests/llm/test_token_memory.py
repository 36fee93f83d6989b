"""A worker keeps no pieces of text when its task is over."""

import pyarrow as pa
from pyspark import TaskContext

from tapeloom.llm import tokens


def test_pieces_are_forgotten_after_a_task(spark, monkeypatch, tmp_path):
    class Frame:  # takes the task's function, to run it here
        def select(self, *_):
            return self

        repartitionByRange = sortWithinPartitions = select

        def mapInArrow(self, run, _schema):
            return run

    class Context:
        def partitionId(self):
            return 0

    monkeypatch.setattr(TaskContext, "get", lambda: Context())
    vocabulary = tokens.default_vocabulary()
    run = tokens.write_shards(Frame(), f"file://{tmp_path}", vocabulary, 1, shard_tokens=4)
    rows = run(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one text and one more, here", "another"]})]))
    enc = tokens.encoder(vocabulary)
    assert next(rows).num_rows == 1 and len(enc.pieces) > 3
    assert sum(b.num_rows for b in rows) == 1 and not enc.pieces and not enc.pieces.older and not enc.tails
