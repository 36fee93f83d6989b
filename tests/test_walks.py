"""Walks with bounded memory: any batch size and any cut into ranges gives what a walk of whole groups gives."""

import random
from collections import Counter
from functools import partial

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom import schema as S
from tapeloom.operators import book, features, nbbo, sequence, walks
from tapeloom.sources import synthetic
from tapeloom.sources.adapter import book_events


def bag(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(params=["small batches", "ranges"])
def cut(spark, request):
    """Batches of 7 rows; with ranges, tasks of about 150 rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "7")
    if request.param == "ranges":
        spark.conf.set(walks.SETTING, "150")
    yield request.param
    spark.conf.set(name, old)
    spark.conf.unset(walks.SETTING)


def numbered():
    """A class that workers get by value."""

    class Numbered(walks.Walker):
        """Counts and sums; a row with what was before it, and a last one with the total."""

        def __init__(self):
            self.n, self.total, self.most, self.key = 0, 0, 0, None

        def feed(self, rows):
            self.most, out = max(self.most, rows.num_rows), []
            for k, v in zip(rows.column("k").to_pylist(), rows.column("v").to_pylist()):
                self.key = k
                out.append((k, self.n, self.total, False))
                self.n, self.total = self.n + 1, self.total + v
            return self._batch(out)

        def end(self):
            return self._batch([(self.key, self.n, self.total, True)])

        @staticmethod
        def _batch(rows):
            types = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["k", "n", "total", "last"])

    return Numbered


@pytest.mark.parametrize("range_rows", [None, 1, 40, 10_000])
def test_every_cut_gives_the_same(spark, range_rows):
    draw = random.Random(1)
    rows = [(draw.choice(["hot", "hot", "hot", "a", "b", None, "ä"]), i, draw.randrange(100)) for i in range(120 if range_rows == 1 else 900)]
    want, state = Counter(), {}
    for k, _, v in rows:
        n, total = state.get(k, (0, 0))
        want[k, n, total, False] += 1
        state[k] = n + 1, total + v
    want.update((k, n, t, True) for k, (n, t) in state.items())
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at int, v int")
    got = walks.walk(df, ["k"], ["at"], numbered(), "k string, n long, total long, last boolean", range_rows)
    assert bag(got) == want


def test_walk_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, at int, v int")
    for range_rows in (None, 10):
        assert walks.walk(empty, ["k"], ["at"], numbered(), "k string, n long, total long, last boolean", range_rows).count() == 0


def test_book_walk_is_the_same_in_any_cut(spark, small, cut):
    """One symbol's tape is larger than a batch and than a range; compat books share a venue over symbols."""
    tape = book_events(spark, small).union(book.enrich(synthetic.lifecycle_tape(spark, 400, 1).withColumn("symbol", F.lit("ONE"))).select(*S.COLUMNS))
    for compat in (False, True):
        rows = tape.orderBy("arrival").collect()
        books, last, want = {}, {}, Counter()
        for r in rows:
            own = books.setdefault(r["venue"] if compat else (r["venue"], r["symbol"]), book.Book(compat))
            ahead = own.apply(r["event_type"], r["symbol"], r["order_id"], r["reference_order_id"], r["side"], r["price"], r["qty"])
            top, key = own.tops(r["symbol"]), (r["venue"], r["symbol"])
            want[(r["arrival"], *key, *top, ahead, top != last.get(key, (None,) * 4))] += 1
            last[key] = top
        got = book.with_tops(tape.repartition(3), compat, keep=["arrival", "venue", "symbol"])
        assert bag(got) == want


def test_recursions_are_the_same_in_any_cut(spark, small, cut):
    quotes = features.two_sided(nbbo.nbbo(book_events(spark, small), keep=["arrival", "venue", "symbol", "event_type", "side", "qty", "price"])).cache()
    state, want = {}, Counter()
    for r in quotes.orderBy("arrival").collect():
        own = state.setdefault(r["symbol"], features.Recursions(200))
        spread, vpin = own.step(r["event_type"] in S.FEATURE_TRADES, r["side"], r["qty"], r["price"], 0.5 * (r["bid_price"] + r["ask_price"]))
        want[r["arrival"], r["symbol"], spread, vpin] += 1
    got = features.with_recursions(quotes, 200).select("arrival", "symbol", "effective_spread", "vpin")
    assert bag(got) == want and len({k[3] for k in want}) > 5


@pytest.mark.parametrize("compat", [False, True])
def test_releases_are_the_same_in_any_cut(spark, cut, compat):
    """Late, lost, doubled and far numbers of two venues; events that are too far come back from memory in compat mode."""
    draw = random.Random(8)
    rows, arrival = [], 0
    for venue in (0, 1):
        seqs = [s for s in range(1, 400) if draw.random() > 0.08]
        seqs = sorted(seqs + draw.sample(seqs, 40), key=lambda s: s + draw.choice([0, 0, 0, 3, 9, 30]) * draw.random())
        for s in [0, *seqs, 5]:
            arrival += 1
            rows.append((arrival, venue, s, f"payload {arrival}"))
    want = Counter()
    for venue in (0, 1):
        own = [r for r in rows if r[1] == venue]
        tracker, n, status, release = sequence.Tracker(8, compat), 0, [], {}
        for i, r in enumerate(own):
            kind, _, out = tracker.observe(r[2], i)
            status.append(kind)
            for j in out:
                n += 1
                release[j] = n
        want.update((*r, status[i], release.get(i)) for i, r in enumerate(own))
    draw.shuffle(rows)
    ev = spark.createDataFrame(rows, "arrival long, venue short, sequence long, what string")
    assert bag(sequence.sequenced(ev, 8, compat)) == want
    stats = {r["venue"]: r.asDict() for r in sequence.tracker_stats(ev, 8, compat).collect()}
    assert stats[0]["too_large"] > 0 and stats[0]["buffered"] > 0 and stats[0]["accepted"] == sum(n for k, n in want.items() if k[1] == 0 and k[5])


def test_release_state_is_bounded():
    walker = sequence.ReleaseWalk(16, False)
    for lo in range(0, 20_000, 500):
        seqs = [s + (s % 5 == 0) * 3 for s in range(lo + 1, lo + 501) if s % 97]
        walker.feed(pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64())], ["sequence"]))
        assert len(walker.waiting) <= 16 + sequence.LOOKBACK
        assert sum(r.nbytes for r, _ in walker.waiting.values()) <= 8 * (16 + sequence.LOOKBACK)


def test_nothing_is_walked_by_whole_groups():
    """No operator of the books, features and sequences hands a whole group to Python."""
    import inspect

    for module in (book, features, sequence):
        assert "applyInArrow" not in inspect.getsource(module) and "applyInPandas" not in inspect.getsource(module)


def test_walks_do_not_shuffle_what_is_dealt_already(spark, small):
    quotes = features.two_sided(nbbo.nbbo(book_events(spark, small), keep=["arrival", "venue", "symbol", "event_type", "side", "qty", "price"]))
    once, again = (df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(symbol") for df in (quotes, features.with_recursions(quotes)))
    assert once == again


def test_walkers_are_pickled_between_ranges():
    import pickle

    for make in (partial(book.TopWalk, ["arrival"]), partial(features.RecursionWalk, 10, 3), partial(sequence.ReleaseWalk, 4, False), partial(sequence.StatsWalk, 4, False), partial(book.LevelWalk, False), partial(book.CompatWalk, ["arrival"])):
        assert isinstance(pickle.loads(pickle.dumps(make())), walks.Walker)
