"""Queue positions, checked books and recovery against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapeloom import schema as S
from tapeloom.operators import book, queues, sequence, walks


def bag(df):
    return Counter(map(tuple, df.collect()))


def tape(spark, rows):
    base = dict(venue=0, event_type=S.ADD, sequence=0, exchange_ts_ns=0, ingest_ts_ns=0, symbol="X", order_id=0, match_id=0, reference_order_id=0, qty=0, price=0, prev_qty=0, prev_price=0, side=2, mpid=None, raw_type=0)
    return spark.createDataFrame([tuple((base | r)[c] for c in S.COLUMNS) for r in rows], S.BOOK_EVENTS)


def wild(n, seed=1):
    """Few prices and ids: long queues, oversize and zero reductions, unknown orders, ids that enter again, replaces with and without a side."""
    draw = random.Random(seed)
    out = []
    for at in range(n):
        kind = draw.choice([S.ADD, S.ADD, S.ADD, S.ADD_MPID, S.EXECUTE, S.CANCEL, S.DELETE, S.REPLACE, S.TRADE])
        out.append(dict(arrival=at, venue=draw.randrange(2), symbol=draw.choice(["A", "B"]), event_type=kind, order_id=draw.randrange(40), reference_order_id=draw.choice([0, draw.randrange(40)]) if kind == S.REPLACE else 0, qty=draw.choice([0, 1, 5, 9, 20]), price=draw.randrange(100, 103), side=draw.choice([0, 1, 2]) if kind == S.REPLACE else draw.choice([0, 1])))
    return out


class Fifo:
    """A plain book with a list a level."""

    def __init__(self):
        self.levels, self.where = {}, {}

    def touch(self, r):
        """Effects of an event: (step, id, side, price, what remains, orders ahead, lots ahead)."""
        kind, oid, side, out = r["event_type"], r["order_id"], r["side"], []
        if kind in (S.EXECUTE, S.EXECUTE_PRICE, S.CANCEL, S.DELETE, S.REPLACE):
            key = (r["reference_order_id"] or oid) if kind == S.REPLACE else oid
            order = self.where.get(key)
            if order:
                queue = self.levels[order["level"]]
                cut = order["left"] if kind in (S.DELETE, S.REPLACE) or r["qty"] == 0 or r["qty"] > order["left"] else r["qty"]
                order["left"] -= cut
                ahead = queue[: next(i for i, o in enumerate(queue) if o is order)]
                out.append((0, key, *order["level"], order["left"], len(ahead), sum(o["left"] for o in ahead)))
                if not order["left"]:
                    del self.where[key]
                    self.levels[order["level"]] = [o for o in queue if o is not order]
                side = order["level"][0] if side == 2 else side
        if kind in (S.ADD, S.ADD_MPID, S.REPLACE) and side < 2 and oid:
            queue = self.levels.setdefault((side, r["price"]), [])
            out.append((len(out), oid, side, r["price"], r["qty"], len(queue), sum(o["left"] for o in queue)))
            order = {"level": (side, r["price"]), "left": r["qty"]}
            queue.append(order)
            self.where[oid] = order
        return out


@pytest.mark.parametrize("range_rows", ["0", "60"])
def test_queue_positions_equal_a_plain_fifo(spark, range_rows):
    rows = wild(700)
    books, want = {}, Counter()
    for r in rows:
        for step, *rest in books.setdefault((r["venue"], r["symbol"]), Fifo()).touch(r):
            want[(r["arrival"], r["venue"], r["symbol"], step, *rest)] += 1
    spark.conf.set(walks.SETTING, range_rows)
    draw = random.Random(3)
    draw.shuffle(rows)
    got = queues.queue_position(tape(spark, rows)).select("arrival", "venue", "symbol", "step", "order_id", "side", "price", "remaining", "orders_ahead", "lots_ahead")
    assert bag(got) == want
    spark.conf.unset(walks.SETTING)
    assert max(k[8] for k in want) > 8


def test_effects_sum_to_the_engines_levels(spark):
    rows = wild(500, 7)
    ev = tape(spark, rows)
    sums = queues.effects(ev).groupBy("venue", "symbol", "side", "price").agg(F.sum("delta").alias("qty")).where("qty > 0")
    want = Counter()
    for key in {(r["venue"], r["symbol"]) for r in rows}:
        own = book.Book()
        for r in rows:
            if (r["venue"], r["symbol"]) == key:
                own.apply(r["event_type"], r["symbol"], r["order_id"], r["reference_order_id"], r["side"], r["price"], r["qty"])
        want.update((*key, side, p, q) for (_, side), ladder in own.sides.items() for p, q in ladder.levels())
    assert bag(sums.select("venue", "symbol", "side", "price", "qty")) == want


@pytest.mark.parametrize("every", [1, 7, 100, 10_000])
def test_sound_books_agree_at_every_checkpoint(spark, every):
    rows = wild(90 if every == 1 else 400, 5)
    got = {r["checkpoint"]: r for r in queues.checked(queues.numbered(tape(spark, rows), every)).collect()}
    assert sorted(got) == list(range(1, -(-len(rows) // every) + 1))
    assert sum(r["events"] for r in got.values()) == len(rows)
    assert all(r["differences"] == r["new_differences"] == 0 for r in got.values()) and any(r["levels"] for r in got.values())


def test_a_planted_error_is_found_at_its_checkpoint(spark):
    rows = [dict(arrival=i, order_id=i + 1, qty=10 + i, price=100 + i, side=0) for i in range(60)]
    points = queues.numbered(tape(spark, rows), 10)
    live = queues.snapshots(points)
    bad = live.withColumn("qty", F.when((F.col("checkpoint") == 4) & (F.col("price") == 112), F.col("qty") + 1).otherwise(F.col("qty")))
    got = {r["checkpoint"]: (r["differences"], r["new_differences"]) for r in queues.checked(points, live=bad).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (1, 1), 5: (0, 1), 6: (0, 0)}  # the replay from a wrong snapshot differs once more
    lost = queues.checked(points, live=queues.snapshots(points.where("arrival <> 23")))
    assert {r["checkpoint"]: (r["differences"], r["new_differences"]) for r in lost.collect()} == {1: (0, 0), 2: (0, 0), 3: (1, 1), 4: (1, 0), 5: (1, 0), 6: (1, 0)}


def test_checkpoints_of_nothing(spark):
    assert queues.checked(queues.numbered(tape(spark, []), 5)).count() == 0
    assert queues.queue_position(tape(spark, [])).count() == 0
    with pytest.raises(ValueError):
        queues.numbered(tape(spark, []), 0)


# -- recovery -----------------------------------------------------------------------------------------------------
def arrivals(seed, n=500):
    draw = random.Random(seed)
    rows = []
    for venue in (0, 1):
        seqs = [s for s in range(1, n) if draw.random() > 0.06 and s % 90 not in range(20, 40)]
        seqs = sorted(seqs + draw.sample(seqs, n // 10), key=lambda s: s + draw.choice([0, 0, 0, 2, 5, 12]) * draw.random())
        rows += [(2 * i + venue, venue, s) for i, s in enumerate(seqs)]
    return rows


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("window", [3, 8])
def test_recovered_events_equal_a_plain_store(spark, window, compat):
    rows = arrivals(window)
    want, asked, given = Counter(), Counter(), Counter()
    for venue in (0, 1):
        tracker, store = sequence.Tracker(window, compat), {}
        for at, _, seq in sorted(r for r in rows if r[1] == venue):
            held, before = set(tracker.held), tracker.stats["reinjected"]
            status, gap, _ = tracker.observe(seq, seq)
            if gap:
                asked[venue, at, *gap, gap[1] - gap[0] + 1, "gap_detected" if status == "gap_buffered" else "gap_too_large"] += 1
            if status == "gap_buffered":
                found = {s: t for s, t in store.items() if gap[0] <= s <= gap[1]}
                want.update((venue, at, s, t, s not in held) for s, t in found.items())
                given[venue] += tracker.stats["reinjected"] - before
            store[seq] = at
            for old in sorted(store)[: -(window + sequence.LOOKBACK)]:
                del store[old]
    ev = spark.createDataFrame(rows, "arrival long, venue short, sequence long")
    seen = sequence.observed(ev, window, compat)
    assert bag(sequence.requests(seen)) == asked
    got = bag(sequence.recovered(seen, window))
    assert got == want
    assert sum(n for k, n in got.items() if k[4]) == sum(given.values()) and bool(sum(given.values())) == compat


def test_requests_of_nothing(spark):
    empty = spark.createDataFrame([], "arrival long, venue short, sequence long")
    seen = sequence.observed(empty, 4)
    assert sequence.requests(seen).count() == 0 and sequence.recovered(seen, 4).count() == 0
