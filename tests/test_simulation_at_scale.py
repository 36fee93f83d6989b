"""Simulated trading keeps the state of a symbol, not its events, and a report trades the tape once."""

import pickle

import pyarrow as pa
from pyspark.sql import functions as F

from tapeloom.functions import stats
from tapeloom.operators import backtest
from tapeloom.plans import operations
from tapeloom.sources.adapter import book_events


def test_a_trader_gives_the_same_in_any_batches_and_keeps_live_orders_only(spark, small):
    rows = backtest.inputs(book_events(spark, small), operations.MM).where("symbol = 'SYM3'").orderBy("arrival").toArrow()
    whole = backtest.Trader(operations.MM).feed(rows.combine_chunks().to_batches()[0])
    cut, parts = backtest.Trader(operations.MM), []
    for at in range(0, rows.num_rows, 7):
        cut = pickle.loads(pickle.dumps(cut))
        parts += [cut.feed(b) for b in rows.slice(at, 7).combine_chunks().to_batches()]
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([whole]))
    assert cut.number > 20 and len(cut.takers) == len(cut.match.orders) <= 2


def test_trading_in_ranges_gives_the_same(spark, small):
    ev = book_events(spark, small)
    once = sorted(backtest.fills(backtest.simulate(ev, operations.OFI)).collect())
    spark.conf.set("tapeloom.walk.rangeRows", "400")
    try:
        ranged = sorted(backtest.fills(backtest.simulate(ev, operations.OFI)).collect())
    finally:
        spark.conf.unset("tapeloom.walk.rangeRows")
    assert once and ranged == once


def test_what_reads_a_curve_does_not_trade_again(spark, small):
    curve = backtest.equity_curve(backtest.simulate(book_events(spark, small), operations.OFI))
    returns = backtest.bucket_returns(curve, operations.HOUR).where("r IS NOT NULL")
    for df in (curve, returns, stats.bootstrap(returns.where(F.col("r") != 0), "r", "bucket", 10, rounds=5)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and "MapInPandas" not in plan and "FlatMapGroups" not in plan
