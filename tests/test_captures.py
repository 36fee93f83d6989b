"""Captures in ranges, and journals and captures that are followed while they grow."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapeloom.sources import captures, decode, files
from tapeloom.sources.adapter import book_events


def messages(n, seed=1):
    """ITCH messages of several types and sizes."""
    draw = random.Random(seed)
    return [(t := draw.choice("AEXDP")).encode() + bytes(draw.randrange(256) for _ in range(files.ITCH_SIZES[t] - 1)) for _ in range(n)]


def capture(some, walk):
    return captures.HEADS.get(walk, b"") + captures.packed(some, walk, a_packet=3)


PLAIN = {"itch_lengths": files.walk_length_prefixed, "itch_raw": files.walk_raw_itch, "cert": files.walk_cert, "pcap": files.walk_pcap}


@pytest.mark.parametrize("walk", list(PLAIN))
def test_every_form_in_any_ranges(spark, tmp_path, walk, monkeypatch):
    monkeypatch.setattr(captures, "BLOCK", 64)
    some = messages(300)
    path = tmp_path / "cap"
    path.mkdir()
    torn = capture(some, walk) + capture(some[:1], walk)[len(captures.HEADS.get(walk, b"")) :][:-3]
    (path / "a.bin").write_bytes(torn)
    (path / "b.bin").write_bytes(capture(some[:7], walk))
    (path / "c.bin").write_bytes(captures.HEADS.get(walk, b""))
    assert [m for m in PLAIN[walk](capture(some, walk))] == some
    want = Counter((f, k, m) for f, own in (("a", some), ("b", some[:7])) for k, m in enumerate(own, 1))
    for every in (1, 700, 1 << 20):
        index = captures.capture_index(spark, str(path), walk, every)
        assert every != 700 or index.where("file like '%a.bin'").count() > 5
        got = captures.read_capture(spark, str(path), walk, index=index)
        assert Counter((os.path.basename(r["file"])[0], r["arrival"], bytes(r["payload"])) for r in got.collect()) == want
    assert got.rdd.getNumPartitions() >= 1


def test_a_file_is_more_than_one_task(spark, tmp_path):
    some = messages(2000)
    (tmp_path / "a.bin").write_bytes(capture(some, "itch_lengths"))
    got = captures.read_capture(spark, str(tmp_path / "a.bin"), every=8 << 10)
    tasks = {r[0] for r in got.select(F.spark_partition_id()).distinct().collect()}
    assert len(tasks) > 3 and got.count() == 2000


def test_limits_end_each_file(spark, tmp_path):
    some = messages(500)
    (tmp_path / "a.bin").write_bytes(capture(some, "itch_lengths"))
    (tmp_path / "b.bin").write_bytes(capture(some, "itch_lengths"))
    few = captures.read_capture(spark, str(tmp_path), every=512, max_events=123)
    assert few.count() == 246 and few.agg(F.max("arrival")).first()[0] == 123
    most = captures.read_capture(spark, str(tmp_path), every=512, max_bytes=3000)
    used, n = 0, 0
    while used + len(some[n]) + 2 <= 3000:
        used, n = used + len(some[n]) + 2, n + 1
    assert most.count() == 2 * n


def test_bad_captures_are_refused(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b"a,b,c\n" * 50)
    (tmp_path / "x.bin").write_bytes(b"?" * 100)
    with pytest.raises(Exception, match="text"):
        captures.read_capture(spark, str(tmp_path / "t.csv"), "pcap").count()
    with pytest.raises(Exception, match="not a capture"):
        captures.read_capture(spark, str(tmp_path / "x.bin"), "pcap").count()
    with pytest.raises(Exception, match="unknown message type"):
        captures.read_capture(spark, str(tmp_path / "x.bin"), "itch_raw").count()
    with pytest.raises(KeyError):
        captures.read_capture(spark, str(tmp_path / "x.bin"), "other")


@pytest.mark.parametrize("walk", list(PLAIN))
def test_written_captures_come_back(spark, small, tmp_path, walk):
    sent = book_events(spark, small).withColumn("exchange_ts_ns", F.col("exchange_ts_ns") % (1 << 47)).select("arrival", decode.itch_payload(F.col("event_type")).alias("payload"))
    path = str(tmp_path / "cap")
    n = captures.write_capture(sent, path, walk, parts=3)
    assert n == sent.where("payload IS NOT NULL").count() and len(os.listdir(path)) == 3
    got = captures.read_capture(spark, path, walk, every=4096)
    assert Counter(bytes(r[0]) for r in got.select("payload").collect()) == Counter(bytes(r[0]) for r in sent.where("payload IS NOT NULL").select("payload").collect())


# -- following ----------------------------------------------------------------------------------------------------
def step(spark, stream, tmp, out="out"):
    """One run of the query over what is there, from the same checkpoint each time."""
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp}/cp-{out}").trigger(availableNow=True).start(f"{tmp}/{out}").awaitTermination()
    return spark.read.parquet(f"{tmp}/{out}")


@pytest.mark.parametrize("walk", ["itch_lengths", "pcap"])
def test_a_growing_capture_loses_and_doubles_nothing(spark, tmp_path, walk):
    some = messages(240, 5)
    raw = capture(some, walk)
    folder = tmp_path / "cap"
    folder.mkdir()
    cuts = [0, 11, 500, 501, len(raw) // 2, len(raw) - 1, len(raw)]
    for a, b in zip(cuts, cuts[1:]):  # appended in torn pieces; each step is a restart
        with open(folder / "a.bin", "ab") as f:
            f.write(raw[a:b])
        if b == len(raw) // 2:
            (folder / "b.bin").write_bytes(capture(some[:20], walk))
        got = step(spark, captures.follow_capture(spark, str(folder), walk, every=256), tmp_path)
        seen = Counter((os.path.basename(r["file"]), r["arrival"], bytes(r["payload"])) for r in got.collect()) if b > 500 else Counter()
        whole = list(PLAIN[walk](raw[:b])) if b > 500 and walk == "itch_lengths" else None
        if whole is not None:
            assert Counter({k: n for k, n in seen.items() if k[0] == "a.bin"}) == Counter(("a.bin", k, m) for k, m in enumerate(whole, 1))
    want = Counter(("a.bin", k, m) for k, m in enumerate(some, 1)) + Counter(("b.bin", k, m) for k, m in enumerate(some[:20], 1))
    assert seen == want


def test_a_growing_journal_loses_and_doubles_nothing(spark, small, tmp_path):
    ev = book_events(spark, small)
    files.write_journal(ev, str(tmp_path / "whole"), parts=1)
    name = next(f for f in os.listdir(tmp_path / "whole") if not f.startswith((".", "_")))
    raw = (tmp_path / "whole" / name).read_bytes()
    width, folder = 24 + files.FORMATS["book"][1], tmp_path / "live"
    folder.mkdir()
    cuts = [0, 5, files.HEADER, files.HEADER + 10 * width + 7, files.HEADER + 11 * width - 1, files.HEADER + 400 * width, len(raw) - 1, len(raw)]
    for a, b in zip(cuts, cuts[1:]):
        with open(folder / name, "ab") as f:
            f.write(raw[a:b])
        stream = files.follow_journal(spark, str(folder), records=100)
        got = step(spark, stream, tmp_path)
        assert got.count() == max(0, b - files.HEADER) // width
    want = files.read_journal(spark, str(tmp_path / "whole"))
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect()))


def test_damaged_records_of_a_growing_journal(spark, small, tmp_path):
    files.write_journal(book_events(spark, small).limit(40), str(tmp_path / "live"), parts=1)
    name = next(f for f in os.listdir(tmp_path / "live") if not f.startswith((".", "_")))
    width = 24 + files.FORMATS["book"][1]
    raw = bytearray((tmp_path / "live" / name).read_bytes())
    raw[files.HEADER + 3 * width + 40] ^= 1  # payload of the fourth record
    raw[files.HEADER + 5 * width + 16] ^= 1  # length of the sixth
    (tmp_path / "live" / name).write_bytes(bytes(raw[:-9]))
    told = step(spark, files.follow_journal(spark, str(tmp_path / "live"), permissive=True), tmp_path, "told")
    assert {r["status"]: r["count"] for r in told.groupBy("status").count().collect()} == {"ok": 37, "record_crc": 1, "record_size": 1}
    assert step(spark, files.follow_journal(spark, str(tmp_path / "live")), tmp_path, "kept").count() == 37


def test_small_blocks_give_the_same_records(tmp_path, monkeypatch):
    some = messages(80, 9)
    for walk in PLAIN:
        (tmp_path / walk).write_bytes(capture(some, walk))
        for block in (1, 37, 1 << 20):
            monkeypatch.setattr(captures, "BLOCK", block)
            with open(tmp_path / walk, "rb") as f:
                assert [m for _, _, own in captures.records(f, captures.form_of(walk), 0) for m in own] == some


@pytest.mark.parametrize("parts", [1, 3, 4, 9])
def test_record_numbers_do_not_hang_on_a_second_run_of_the_plan(spark, small, tmp_path, parts):
    """The numbers in the records are those of the order, whatever ranges the files got."""
    import numpy as np

    ev = book_events(spark, small)
    n = files.write_journal(ev, str(tmp_path / "j"), parts=parts)
    assert files.write_journal(ev, str(tmp_path / "j"), parts=parts, append=True) == n
    dtype = files.record_dtype("book")
    got = np.concatenate([np.fromfile(tmp_path / "j" / f, dtype, offset=files.HEADER) for f in sorted(os.listdir(tmp_path / "j"))])
    assert got["env_monotonic_seq"].tolist() == list(range(2 * n))
    want = [r[0] for r in ev.orderBy("arrival").select("order_id").collect()]
    assert got["order_id"].tolist() == want * 2
    assert files.write_journal(ev.limit(0), str(tmp_path / "none")) == 0 and files.read_journal(spark, str(tmp_path / "none")).count() == 0


# -- packets of repeating groups ------------------------------------------------------------------------------------
def sbe(draw, sound=False):
    """A packet of any messages: other templates, short groups, wide entries, nulls, torn and wrong sizes (unless it shall be sound)."""
    out = draw.randrange(1 << 32).to_bytes(4, "little") + draw.choice([0, draw.randrange(1 << 60)]).to_bytes(8, "little")
    for _ in range(draw.randrange(4)):
        width, n = draw.choice([32, 32, 40, 32 if sound else 10]), draw.randrange(5, 9) if sound else draw.randrange(5)
        body = draw.choice([0, draw.randrange(1 << 60)]).to_bytes(8, "little") + bytes(3) + width.to_bytes(2, "little") + bytes([n])
        for _ in range(n):
            price = draw.choice([(1 << 63) - 1, 0, -5, draw.randrange(1 << 62), 450_000_000])
            e = price.to_bytes(8, "little", signed=True) + draw.choice([-3, 0, 70, 2**31 - 1]).to_bytes(4, "little", signed=True) + draw.choice([2**31 - 1, 42, -7, 123456789]).to_bytes(4, "little", signed=True)
            e += draw.choice([0, 9, 2**32 - 1]).to_bytes(4, "little") + bytes(5) + bytes([draw.randrange(7)]) + draw.choice(b"01JE").to_bytes(1, "little")
            body += e.ljust(width, b"\0")[:width]
        size = 10 + len(body) + (0 if sound else draw.choice([0, 0, 0, 0, 3, -20, 500]))
        out += max(0, size).to_bytes(2, "little") + bytes(2) + draw.choice([32, 32, 32, 4, 288]).to_bytes(2, "little") + bytes(4) + body
    return out if sound else out[: len(out) - draw.choice([0, 0, 0, 1, 9])]


def test_packets_by_columns_equal_packets_one_by_one(spark):
    import pyarrow as pa

    draw = random.Random(4)
    packets = [sbe(draw) for _ in range(3000)] + [b"", b"short", bytes(12), None]
    signed = lambda e: (e[0], (e[1] + 2**63) % 2**64 - 2**63, *e[2:])  # noqa: E731  numbers are 64 bits
    want = [(p, k, *signed(e)) for p, packet in enumerate(packets) for k, e in enumerate(decode.sbe_packet(packet or b""))]
    found = decode.sbe_columns(pa.array(packets, pa.binary()))
    got = list(zip(*(found[n].tolist() for n in ("packet", "nth", "event_type", "sequence", "ts", "symbol", "qty", "price", "side"))))
    assert got == want and len(want) > 500
    assert {e[2] for e in want} == {0, 5, 6, 255} and {e[8] for e in want} == {0, 1, 2}
    df = spark.createDataFrame([(k, bytes(p) if p is not None else None, 5) for k, p in enumerate(packets)], "arrival long, payload binary, ingest_ts_ns long")
    rows = decode.decode_sbe(df).select("arrival", "event_type", "sequence", "exchange_ts_ns", "symbol", "qty", "price", "side").collect()
    assert Counter(map(tuple, rows)) == Counter((p * 256 + k, *rest) for p, k, *rest in want)


def test_packets_are_decoded_by_the_million():
    """A million entries a second and more on one thread; half of that is asked for here, as other work may run beside it."""
    import time

    import pyarrow as pa

    draw = random.Random(6)
    packets = pa.array([sbe(draw, True) for _ in range(2000)] * 20, pa.binary())
    decode.sbe_columns(packets)
    began = time.process_time()
    n = len(decode.sbe_columns(packets)["nth"])
    assert n / (time.process_time() - began) > 500_000
