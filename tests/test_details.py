"""Provenance of quotes, fills over ranges, reports and health."""

import os
import random
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapeloom import schema as S
from tapeloom.functions import ranks
from tapeloom.operators import backtest, book, nbbo, research, sequence, service
from tapeloom.sources import files
from tapeloom.sources.adapter import book_events


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def tape(spark, rows):
    base = dict(venue=0, event_type=S.ADD, sequence=0, exchange_ts_ns=0, ingest_ts_ns=0, symbol="X", order_id=0, match_id=0, reference_order_id=0, qty=0, price=0, prev_qty=0, prev_price=0, side=2, mpid=None, raw_type=0)
    return spark.createDataFrame([tuple((base | {"arrival": k} | r)[c] for c in S.COLUMNS) for k, r in enumerate(rows)], S.BOOK_EVENTS)


def plain_quotes(rows):
    """A consolidator of venues' tops that notes the message of each side; a quote whenever one of its ten fields changes."""
    books, venues, last, out = {}, {}, {}, []
    for r in rows:
        key = r["venue"], r["symbol"]
        own = books.setdefault(key, book.Book())
        before = own.tops(r["symbol"])
        own.apply(r["event_type"], r["symbol"], r["order_id"], r["reference_order_id"], r["side"], r["price"], r["qty"])
        top = own.tops(r["symbol"])
        if top == before:
            continue
        venues[key] = (*top, r["sequence"])
        seen = {v: t for (v, s), t in venues.items() if s == r["symbol"]}
        bid = max(((t[0], -v, t[1], t[4]) for v, t in seen.items() if t[0] is not None), default=None)
        ask = min(((t[2], v, t[3], t[4]) for v, t in seen.items() if t[2] is not None), default=None)
        now = ((bid[0], bid[2], -bid[1]) if bid else (None,) * 3) + ((ask[0], ask[2], ask[1]) if ask else (None,) * 3) + (bid[3] if bid else None, ask[3] if ask else None)
        if now != last.get(r["symbol"], (None,) * 8):
            out.append((r, now))
        last[r["symbol"]] = now
    return out


def quoted_tape(n=400):
    draw = random.Random(12)
    return [dict(arrival=k, venue=draw.randrange(3), symbol=draw.choice(["A", "LONGNAME"]), event_type=draw.choice([S.ADD, S.ADD, S.DELETE, S.EXECUTE, S.TRADE]), order_id=draw.randrange(1, 30), reference_order_id=0, sequence=1000 + k, exchange_ts_ns=5 * k, ingest_ts_ns=5 * k + 1, qty=draw.randrange(1, 9), price=draw.randrange(100, 104), side=draw.randrange(2)) for k in range(n)]


def test_provenance_and_its_checksum_equal_a_plain_consolidator(spark):
    rows = quoted_tape()
    want = plain_quotes(rows)
    found = nbbo.provenance(tape(spark, rows))
    got = Counter(map(tuple, found.select("arrival", "symbol", *nbbo.BBO, *nbbo.SEQUENCES).collect()))
    assert got == Counter((r["arrival"], r["symbol"], *q) for r, q in want)
    none = lambda v: 0 if v is None else v
    raw = b""
    for r, q in want:
        code = int.from_bytes(r["symbol"].encode().ljust(8)[:8], "big")
        raw += struct.pack("<QQQBBxxIIIIBBxxQQ", code, r["exchange_ts_ns"], r["ingest_ts_ns"], q[0] is not None, q[3] is not None, *(none(q[k]) for k in (0, 1, 3, 4)), none(q[2]), none(q[5]), none(q[6]), none(q[7]))
    for parts in (None, 1, 7):
        crc = sequence.chained_crc(found, files.quote_payloads, 64, parts=parts).first()
        assert (crc["crc"], crc["events"]) == (zlib.crc32(raw), len(want))


def test_quote_payloads_are_those_of_the_journal(spark, tmp_path):
    import numpy as np

    found = nbbo.provenance(tape(spark, quoted_tape(120)))
    files.write_journal(found, str(tmp_path / "q"), "nbbo", parts=2)
    width = 24 + files.FORMATS["nbbo"][1]
    raw = b""
    for f in sorted((tmp_path / "q").iterdir()):
        rows = np.frombuffer(f.read_bytes()[files.HEADER :], np.uint8).reshape(-1, width)
        raw += rows[:, 24:].tobytes()
    assert sequence.chained_crc(found, files.quote_payloads, 64).first()["crc"] == zlib.crc32(raw)


@pytest.mark.parametrize("n", [1, 2, 300])
def test_last_values_over_ranges(spark, n):
    draw = random.Random(n)
    rows = [(k * draw.choice([1, 1, 1, 50]) + k, draw.choice([None, None, draw.randrange(9)])) for k in range(n)]
    rows = sorted({o: v for o, v in rows}.items())
    want, last = Counter(), None
    for o, v in rows:
        want[o, v, last] += 1
        last = v if v is not None else last
    got = ranks.last_before(spark.createDataFrame(rows[::-1], "o long, v int"), "o", "v")
    assert Counter(map(tuple, got.select("o", "v", "last").collect())) == want


@pytest.mark.parametrize("n", [1, 400])
def test_sums_and_last_values_by_keys_over_ranges(spark, n):
    draw = random.Random(n)
    rows = [(3 * k, draw.choice(["a", "a", "b", None]), draw.choice([None, draw.randrange(9)])) for k in range(n)]
    sums, last, want = {}, {}, Counter()
    for o, k, v in rows:
        sums[k] = sums.get(k, 0) + (v or 0)
        want[o, k, v, sums[k], last.get(k)] += 1
        last[k] = v if v is not None else last.get(k)
    df = spark.createDataFrame(rows[::-1], "o long, k string, v int")
    got = ranks.last_before(ranks.running_sum(df, "o", "v", "s", by=["k"]), "o", "v", "l", by=["k"])
    assert Counter(map(tuple, got.select("o", "k", "v", "s", "l").collect())) == want


def test_forward_fill_of_all_rows_is_not_one_window(spark):
    rows = [dict(exchange_ts_ns=t) for t in (0, 7, 0, 0, 9, 0)]
    filled = sequence.forward_fill_time(tape(spark, rows))
    assert [r["exchange_ts_ns"] for r in filled.orderBy("arrival").collect()] == [0, 7, 7, 7, 9, 9]
    assert sequence.forward_fill_time(tape(spark, [])).count() == 0
    import re

    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Window \[[^\]]*\], \[arrival", plan)


def test_bucket_returns_skip_empty_buckets(spark):
    curve = spark.createDataFrame([(0, 5, 1.0), (1, 6, 2.0), (2, 31, 4.0), (3, 99, 3.0)], "arrival long, exchange_ts_ns long, equity double")
    got = {r["bucket"]: (r["equity"], r["r"]) for r in backtest.bucket_returns(curve, 10).collect()}
    assert got == {0: (1.0, None), 3: (4.0, 3.0), 9: (3.0, -1.0)}


def test_ablation_report_has_its_five_rows(spark):
    draw = random.Random(2)
    rows = [("ofi", k % 5, k, draw.uniform(-1, 1), draw.uniform(-1, 1)) for k in range(200)] + [("other", 0, k, 1.0, 1.0) for k in range(20)]
    pairs = spark.createDataFrame([(s, 60, f, a, v, r) for s, f, a, v, r in rows], "signal string, horizon long, fold int, arrival long, value double, label double")
    spreads = spark.createDataFrame([(k, 0.5) for k in range(200)], "arrival long, spread double")
    got = {r["variant"]: r for r in research.ablation_report(pairs, "ofi", spreads, F.lit(1.25)).collect()}
    assert set(got) == {"full_signal", "ablate_ofi_component", "ablate_microprice_component", "no_cost_model", "phase0_ofi_baseline"}
    r = [(v > 0) * x - (v < 0) * x for s, _, _, v, x in rows if s == "ofi"]
    mean = sum(r) / len(r)
    want = mean / (sum((x - mean) ** 2 for x in r) / len(r)) ** 0.5
    assert abs(got["no_cost_model"]["net_sharpe"] - want) < 1e-9 and got["phase0_ofi_baseline"]["net_sharpe"] == 1.25
    assert got["no_cost_model"]["mean_ic"] == got["full_signal"]["mean_ic"] == got["phase0_ofi_baseline"]["mean_ic"]


def test_health_says_what_is_served(spark, small):
    ev = book_events(spark, small)
    catalog = service.Catalog(ev, nbbo.changes(nbbo.nbbo(ev, keep=["arrival", "venue", "symbol", "exchange_ts_ns"])), "a/book", "a/nbbo")
    told = catalog.health()
    assert told["book_records"] == ev.count() and told["book_journal_path"] == "a/book" and told["nbbo_journal_path"] == "a/nbbo"
    assert told["uptime_seconds"] >= 0 and told["build_id"].startswith("tapeloom-") and "not" not in told["status"].lower() and "no live" in told["service_mode"]
    assert catalog.health()["uptime_seconds"] >= told["uptime_seconds"]
    catalog.close()


def test_scan_status(spark):
    rows = spark.createDataFrame([(3, "record_crc"), (1, "ok"), (2, "unexpected_eof")], "arrival long, status string")
    assert tuple(service.scan_status(rows).first()) == ("DATA_LOSS", "unexpected_eof", 2)
    assert tuple(service.scan_status(rows.where("status = 'ok'")).first()) == ("OK", None, 0)
    assert tuple(service.scan_status(rows.limit(0)).first()) == ("OK", None, 0)


def test_the_catalogue_is_read_without_a_session():
    """Names, queries and SQL need no Spark."""
    import subprocess
    import sys

    told = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", told], capture_output=True, text=True, cwd=ROOT)
    assert out.returncode == 0 and int(out.stdout) > 90, out.stderr[-500:]


def test_all_signals_of_the_zoo_are_evaluated(spark):
    from tapeloom.plans.research import SIGNALS

    assert set(SIGNALS) == set(research.SignalRegistry().signals)
