"""Live books: equal to the batch form over micro-batches, with a state that goes with what is live."""

from collections import Counter

from pyspark.sql import functions as F

from tapeloom import schema as S
from tapeloom.operators import book, nbbo
from tapeloom.sources.adapter import book_events
from tapeloom.streaming import books, stateful

COLS = ["arrival", "venue", "symbol", "bid_price", "bid_qty", "ask_price", "ask_qty", "queue_ahead", "changed_top"]


def bag(df):
    return Counter(map(tuple, df.collect()))


def run(spark, df, tmp, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp}/{name}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name), q


def in_files(spark, ev, path, n):
    """n files in order of arrival, one a micro-batch."""
    cut = [r[0] for r in ev.select(F.expr(f"explode(approx_percentile(arrival, array({', '.join(f'{k / n:.3f}D' for k in range(1, n))})))")).collect()]
    for lo, hi in zip([None, *cut], [*cut, None]):
        part = ev.where((F.lit(lo).isNull() | (F.col("arrival") > F.lit(lo))) & (F.lit(hi).isNull() | (F.col("arrival") <= F.lit(hi))))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streamed_tops_equal_the_batch_over_five_micro_batches(spark, small, tmp_path):
    ev = book_events(spark, small).persist()
    stream = in_files(spark, ev, str(tmp_path / "tape"), 5)
    got, q = run(spark, stateful.tops(stream), tmp_path, "live_tops")
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 5
    assert bag(got.select(COLS)) == bag(book.with_tops(ev).select(COLS))
    live = book.deltas(ev).groupBy("venue", "order_id").agg(F.sum("delta").alias("left")).where("left > 0").count()
    levels = book.live_levels(ev).count()
    held = {v: spark.read.format("statestore").option("path", f"{tmp_path}/live_tops").option("stateVarName", v).load().count() for v in ("orders", "levels")}
    assert held == {"orders": live, "levels": levels}


def test_state_goes_with_live_orders_not_with_events(spark, tmp_path):
    """Many orders come and go; what is stored stays the same size."""
    base = dict(venue=0, event_type=S.ADD, sequence=0, exchange_ts_ns=0, ingest_ts_ns=0, symbol="X", order_id=0, match_id=0, reference_order_id=0, qty=5, price=100, prev_qty=0, prev_price=0, side=0, mpid=None, raw_type=0)
    rows = []
    for k in range(1, 401):
        rows.append(base | dict(arrival=2 * k, order_id=k, price=100 + k % 7))
        if k > 10:
            rows.append(base | dict(arrival=2 * k + 1, order_id=k - 10, event_type=S.DELETE))
    ev = spark.createDataFrame([tuple(r[c] for c in S.COLUMNS) for r in rows], S.BOOK_EVENTS)
    stream = in_files(spark, ev, str(tmp_path / "tape"), 5)
    got, q = run(spark, books.tops(stream), tmp_path, "coming_and_going")
    assert got.count() == len(rows)
    sizes = [op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]]
    memory = [op["memoryUsedBytes"] for p in q.recentProgress for op in p["stateOperators"]]
    held = {v: spark.read.format("statestore").option("path", f"{tmp_path}/coming_and_going").option("stateVarName", v).load().count() for v in ("orders", "levels")}
    assert held == {"orders": 10, "levels": 7} and max(sizes) <= 3 * (10 + 7) and max(memory) < 64 << 20


def test_idle_books_are_evicted(spark, tmp_path):
    base = dict(venue=0, event_type=S.ADD, sequence=0, ingest_ts_ns=0, match_id=0, reference_order_id=0, qty=5, prev_qty=0, prev_price=0, side=0, mpid=None, raw_type=0)
    minute = 60_000_000_000
    rows = [base | dict(arrival=k, symbol="IDLE" if k < 5 else "BUSY", order_id=k + 1, price=100 + k, exchange_ts_ns=k * minute) for k in range(40)]
    rows.append(base | dict(arrival=41, symbol="IDLE", order_id=99, price=7, exchange_ts_ns=41 * minute))
    ev = spark.createDataFrame([tuple(r[c] for c in S.COLUMNS) for r in rows], S.BOOK_EVENTS)
    stream = in_files(spark, ev, str(tmp_path / "tape"), 5)
    got, _ = run(spark, books.tops(stream, idle="10 minutes"), tmp_path, "idle_books")
    last = {r["arrival"]: r for r in got.collect()}
    assert last[4]["bid_price"] == 104 and last[39]["bid_price"] == 139
    assert last[41]["bid_price"] == 7 and last[41]["changed_top"]  # the book began anew
    state = spark.read.format("statestore").option("path", f"{tmp_path}/idle_books").option("stateVarName", "orders").load()
    assert state.where("key.symbol = 'IDLE'").count() <= 1


def test_feed_sides_have_books_of_their_own(spark, small, tmp_path):
    ev = book_events(spark, small)
    both = ev.withColumn("feed", F.lit("A")).unionByName(ev.where("sequence % 5 <> 0").withColumn("feed", F.lit("B")))
    stream = in_files(spark, both, str(tmp_path / "tape"), 2)
    got, _ = run(spark, books.tops(stream), tmp_path, "feed_sides")
    for feed, tape in (("A", ev), ("B", ev.where("sequence % 5 <> 0"))):
        assert bag(got.where(F.col("feed") == feed).select(COLS)) == bag(book.with_tops(tape).select(COLS))


def test_a_restart_goes_on_with_the_stored_books(spark, small, tmp_path):
    ev = book_events(spark, small).persist()
    middle = ev.agg(F.expr("percentile_approx(arrival, 0.5)")).first()[0]
    path = str(tmp_path / "tape")
    stream = spark.readStream.schema(ev.schema).parquet
    out, cols = str(tmp_path / "out"), COLS
    for part in (ev.where(F.col("arrival") <= middle), ev.where(F.col("arrival") > middle)):
        part.coalesce(1).write.mode("append").parquet(path)
        tops = books.tops(stream(path))
        tops.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(out).awaitTermination()
    assert bag(spark.read.parquet(out).select(cols)) == bag(book.with_tops(ev).select(cols))


def test_quotes_of_streamed_tops(spark, small, tmp_path):
    """What follows the tops in a batch is fed by the stored stream as well."""
    ev = book_events(spark, small)
    stream = in_files(spark, ev, str(tmp_path / "tape"), 3)
    got, _ = run(spark, books.tops(stream), tmp_path, "then_quotes")
    want = nbbo.nbbo(ev, keep=["arrival", "venue", "symbol"]).select("arrival", *nbbo.BBO)
    assert bag(nbbo.consolidate(got).select("arrival", *nbbo.BBO)) == bag(want)
