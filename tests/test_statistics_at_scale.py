"""Statistics that no longer pass through the driver or one task."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom import schema as S
from tapeloom.functions import stats
from tapeloom.operators import sequence


def plain_start(seed, number, block, n):
    return int(hashlib.md5(f"{seed}:{number}:{block}".encode()).hexdigest()[:15], 16) % n


@pytest.mark.parametrize("n,block", [(1, 1), (7, 3), (50, 8), (50, 1), (10, 99)])
def test_bootstrap_equals_a_plain_one(spark, n, block, monkeypatch):
    monkeypatch.setattr(stats, "PREFIX_BLOCK", 4)
    draw = random.Random(n)
    x = [draw.uniform(-1, 1.2) for _ in range(n)]
    series = spark.createDataFrame(draw.sample([(k * 3 - 20, v) for k, v in enumerate(x)], n), "k int, v double")
    size, means = min(block, n), []
    blocks = -(-n // size)
    for number in range(60):
        total = 0.0
        for b in range(blocks):
            at = plain_start(11, number, b, n)
            total += sum(x[(at + j) % n] for j in range(n - size * (blocks - 1) if b == blocks - 1 else size))
        means.append(total / n)
    got = stats.bootstrap(series, "v", "k", block, 60, 11).first()
    assert got["n"] == n and math.isclose(got["mean"], sum(means) / 60, abs_tol=1e-9) and math.isclose(got["p_value"], sum(m <= 1e-15 for m in means) / 60)


def test_bootstrap_of_nothing(spark):
    got = stats.bootstrap(spark.createDataFrame([], "k int, v double"), "v", "k", 5, 20).first()
    assert (got["p_value"], got["mean"], got["n"]) == (1.0, 0.0, 0)


def test_prefix_sums(spark, monkeypatch):
    monkeypatch.setattr(stats, "PREFIX_BLOCK", 3)
    x = [4.0, -1.0, 2.5, 8.0, 0.0, 1.0, 1.0]
    series = spark.createDataFrame([(k * k, v) for k, v in enumerate(x)], "k long, v double")
    assert [r["upto"] for r in stats.prefix_sums(series, "v", "k").orderBy("at").collect()] == [0.0, *np.cumsum(x)]


@pytest.mark.parametrize("kind", ["long", "int", "double", "ties", "one"])
def test_nearest_rank_equals_sorting(spark, kind):
    draw = random.Random(3)
    values = {
        "long": [draw.choice([-1, 1]) * draw.getrandbits(draw.randrange(1, 63)) for _ in range(400)] + [2**63 - 1, -(2**63)],
        "int": [draw.randrange(-70_000, 70_000) for _ in range(300)],
        "double": [draw.choice([-1, 1]) * 10.0 ** draw.uniform(-300, 300) for _ in range(300)] + [math.inf, -math.inf, 0.0, -0.0, 5e-324],
        "ties": [draw.choice([-3, 0, 7]) for _ in range(500)],
        "one": [42],
    }[kind]
    df = spark.createDataFrame([(v,) for v in [*values, None]], f"v {'double' if kind == 'double' else 'int' if kind == 'int' else 'long'}")
    ordered = sorted(values)
    for p in (0.0, 0.25, 0.5, 0.99, 1.0):
        assert stats.nearest_rank(df, "v", p).first()["value"] == ordered[math.floor(p * (len(ordered) - 1))]


def test_nearest_rank_of_nothing(spark):
    assert stats.nearest_rank(spark.createDataFrame([(None,)], "v long"), "v", 0.5).first()["value"] is None


def test_ranks_have_no_window_over_values(spark):
    """The windows order 16-bit patterns, never the values."""
    plan = stats.nearest_rank(spark.range(100).withColumnRenamed("id", "v"), "v", 0.5)._jdf.queryExecution().optimizedPlan().toString()
    import re

    ordered = set(re.findall(r"windowspecdefinition\((\w+)#", plan))
    assert ordered == {"digits"}


def events(spark, n, seed=2):
    draw = random.Random(seed)
    base = dict(arrival=0, ingest_ts_ns=0, match_id=0, reference_order_id=0, prev_qty=0, prev_price=0, side=0, mpid=None, raw_type=0)
    rows = [base | dict(arrival=3 * k - 50, venue=draw.randrange(5), event_type=draw.randrange(12), sequence=draw.getrandbits(62), exchange_ts_ns=draw.getrandbits(62), symbol=draw.choice(["", "A", "ABCDEFGH", "LONGERNAME", "X Y"]), order_id=draw.getrandbits(63), qty=draw.getrandbits(32), price=draw.getrandbits(32)) for k in range(n)]
    raw = b"".join(struct.pack("<BBQQ8sQII", r["venue"], r["event_type"], r["sequence"], r["exchange_ts_ns"], r["symbol"].encode()[:8].ljust(8), r["order_id"], r["qty"], r["price"]) for r in rows)
    draw.shuffle(rows)
    return spark.createDataFrame([tuple(r[c] for c in S.COLUMNS) for r in rows], S.BOOK_EVENTS), raw


def test_witness_is_the_crc_of_all_bytes_in_any_ranges(spark):
    ev, raw = events(spark, 700)
    for parts in (None, 1, 2, 13, 50):
        got = sequence.witnessed(ev.repartition(3), parts=parts).first()
        assert (got["crc"], got["events"]) == (zlib.crc32(raw), 700)
    assert sequence.witness(ev.limit(0)) == 0


def test_witness_bytes_are_packed_by_columns():
    import time

    n = 200_000
    batch = pa.RecordBatch.from_pydict({"venue": pa.array([1] * n, pa.int16()), "event_type": pa.array([2] * n, pa.int16()), **{c: pa.array(range(n), pa.int64()) for c in ("sequence", "exchange_ts_ns", "order_id", "qty", "price")}, "symbol": ["ABC"] * n})
    began = time.process_time()
    assert len(sequence.witness_bytes(batch)) == 42 * n
    assert n / (time.process_time() - began) > 500_000
    assert sequence.witness_bytes(batch)[:42] == struct.pack("<BBQQ8sQII", 1, 2, 0, 0, b"ABC     ", 0, 0, 0)


def test_no_statistic_collects_a_series():
    import inspect

    for f in (stats.bootstrap, stats.prefix_sums, stats.nearest_rank, sequence.witnessed):
        source = inspect.getsource(f)
        assert ".collect(" not in source and "toPandas" not in source and ".broadcast(sums" not in source


def test_first_ranges_may_be_empty(spark):
    ev, raw = events(spark, 3)
    assert sequence.witness(ev.where(F.col("arrival") >= -50), parts=40) == zlib.crc32(raw)
