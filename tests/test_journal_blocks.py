"""A journal's reader holds a block of records, and a scan has a bounded number of partitions."""

import pyarrow as pa

from tapeloom.sources import files
from tapeloom.sources.adapter import book_events


def test_ranges_are_read_by_blocks_and_their_number_is_bounded(spark, small, tmp_path, monkeypatch):
    path = str(tmp_path / "journal")
    n = files.write_journal(book_events(spark, small), path, parts=2)
    reader = files.JournalReader({"path": path, "mode": "permissive"})
    whole = pa.Table.from_batches([b for p in reader.partitions() for b in reader.read(p)])
    monkeypatch.setattr(files, "BLOCK", 100)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert max(b.num_rows for b in batches) == 100 and pa.Table.from_batches(batches).combine_chunks().equals(whole.combine_chunks())
    assert whole.num_rows == n and whole.column("arrival").to_pylist() == list(range(n))
    follower = files.JournalFollower({"path": path})
    followed = [b for p in follower.partitions({}, follower.latestOffset()) for b in follower.read(p)]
    assert max(b.num_rows for b in followed) == 100 and sum(b.num_rows for b in followed) == n

    monkeypatch.setattr(files, "MOST_PARTS", 8)
    few = files.JournalReader({"path": path, "records": "1", "mode": "permissive"})
    assert len(few.partitions()) <= 8 + 2
    assert pa.Table.from_batches([b for p in few.partitions() for b in few.read(p)]).combine_chunks().equals(whole.combine_chunks())
