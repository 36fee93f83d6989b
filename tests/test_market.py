import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom import schema as S
from tapeloom.functions import ranks, stats
from tapeloom.operators import backtest, book, features, nbbo, research, sequence, service
from tapeloom.sources import crypto, decode, files, synthetic
from tapeloom.sources.adapter import book_events


def tape(spark, rows, **defaults):
    """Events from dicts; arrival counts up."""
    base = dict(venue=0, event_type=S.ADD, sequence=0, exchange_ts_ns=0, ingest_ts_ns=0, symbol="X", order_id=0, match_id=0, reference_order_id=0, qty=0, price=0, prev_qty=0, prev_price=0, side=2, mpid=None, raw_type=0)
    return spark.createDataFrame([tuple((base | {"arrival": k} | defaults | r)[c] for c in S.COLUMNS) for k, r in enumerate(rows)], S.BOOK_EVENTS)


def statuses(window, seqs):
    t = sequence.Tracker(window)
    return [t.observe(s, s) for s in seqs], t


def test_tracker_reorder():
    seen, t = statuses(8, [1, 4, 2, 3])
    assert [s for s, _, _ in seen] == ["in_order", "gap_buffered", "in_order", "in_order"]
    assert seen[1][1] == (2, 3) and seen[3][2] == [3, 4] and t.next == 5


def test_tracker_too_far_and_duplicate():
    t = sequence.Tracker(2, compat=True)
    assert t.observe(1, 1)[0] == "in_order" and t.observe(1, 1)[0] == "duplicate"
    kind, gap, out = t.observe(5, 5)
    assert (kind, gap, out) == ("gap_too_large", (2, 4), [])
    assert t.observe(5, 5)[0] == "in_order"
    strict = sequence.Tracker(2)
    strict.observe(1, 1)
    assert strict.observe(5, 5)[2] == [5] and strict.next == 6


def test_tracker_pending_dedupe():
    seen, t = statuses(1024, [*range(1, 39), *range(41, 101)])
    assert t.stats["accepted"] == 38 and t.stats["buffered"] == 60 and t.stats["reinjected"] == 0


def test_sequenced_frame(spark):
    ev = tape(spark, [{"sequence": s} for s in (1, 3, 2, 2, 4)])
    got = {r["arrival"]: (r["status"], r["release"]) for r in sequence.sequenced(ev, 8).collect()}
    assert got == {0: ("in_order", 1), 1: ("gap_buffered", 3), 2: ("in_order", 2), 3: ("duplicate", None), 4: ("in_order", 4)}


def test_merge_equals_greedy(spark):
    rng = np.random.default_rng(3)
    rows = [{"venue": int(v), "exchange_ts_ns": int(t), "sequence": k, "raw_type": int(t) % 3} for k, (v, t) in enumerate(zip(rng.integers(0, 3, 120), rng.integers(0, 30, 120)))]
    queues = {v: [(r["exchange_ts_ns"], v, r["sequence"], r["raw_type"]) for r in rows if r["venue"] == v] for v in range(3)}
    want = []
    while any(queues.values()):
        v = min((q[0], v) for v, q in queues.items() if q)[1]
        want.append(queues[v].pop(0)[2])
    got = [r["sequence"] for r in sequence.merge_order(tape(spark, rows)).orderBy("merge_rank").collect()]
    assert got == want


def test_witness_matches_zlib_and_parts(spark):
    ev = tape(spark, [{"sequence": k, "order_id": k * 7, "qty": k, "price": 100 + k, "exchange_ts_ns": k} for k in range(50)])
    want = 0
    for k in range(50):
        want = zlib.crc32(struct.pack("<BBQQ8sQII", 0, 0, k, k, b"X".ljust(8), k * 7, k, 100 + k), want)
    assert sequence.witness(ev, parts=1) == sequence.witness(ev.repartition(5), parts=6) == want


def test_burst_loss_keeps_whole_stream(spark):
    ev = tape(spark, [{"sequence": k + 1} for k in range(300)])
    a = ev.where("sequence < 100 OR sequence > 150").withColumn("feed", F.lit("A"))
    assert sequence.arbitrate(a.unionByName(ev.withColumn("feed", F.lit("B")))).count() == 300


LIFE = [
    {"order_id": 1, "side": 0, "price": 10_000, "qty": 200},
    {"order_id": 2, "side": 1, "price": 10_020, "qty": 300},
    {"event_type": S.EXECUTE, "order_id": 1, "qty": 50},
    {"event_type": S.CANCEL, "order_id": 2, "qty": 0},
    {"event_type": S.REPLACE, "order_id": 3, "reference_order_id": 1, "price": 10_020, "qty": 120},
]


def test_book_lifecycle(spark):
    got = [(r["bid_price"], r["bid_qty"], r["ask_price"]) for r in book.with_tops(tape(spark, LIFE)).orderBy("arrival").collect()]
    assert got == [(10_000, 200, None), (10_000, 200, 10_020), (10_000, 150, 10_020), (10_000, 150, None), (10_020, 120, None)]


def test_book_traps():
    strict, compat = book.Book(), book.Book(compat=True)
    for b in (strict, compat):
        b.apply(S.ADD, "X", 1, 0, 0, 100, 10)
        b.apply(S.DELETE, "X", 1, 0, 2, 0, 4)
    assert strict.tops("X")[:2] == (None, None) and compat.tops("X")[:2] == (100, 6)
    for b in (strict, compat):
        b.apply(S.ADD, "Y", 0, 0, 0, 50, 5)
    assert strict.tops("Y")[0] is None and compat.tops("Y")[0] == 50
    for b in (strict, compat):
        b.apply(S.ADD, "Z", 9, 0, 1, 70, 5)
        b.apply(S.REPLACE, "Z", 10, 9, 2, 71, 5)
    assert strict.tops("Z")[2] == 71 and compat.tops("Z")[2] is None


def test_flat_walk_equals_the_book():
    rng = np.random.default_rng(6)
    n = 4000
    kinds = rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 255], n).tolist()
    ids, refs = rng.integers(0, 60, n).tolist(), rng.integers(0, 60, n).tolist()
    sides, prices, qtys = rng.integers(0, 3, n).tolist(), rng.integers(90, 110, n).tolist(), rng.integers(0, 9, n).tolist()
    b, want, last = book.Book(), [], (None,) * 4
    for row in zip(kinds, ids, refs, sides, prices, qtys):
        ahead = b.apply(row[0], "X", *row[1:])
        top = b.tops("X")
        want.append((*top, ahead, top != last))
        last = top
    assert list(zip(*book.walk_strict(kinds, ids, refs, sides, prices, qtys))) == want


def test_enrich_gives_orders_their_symbol(spark):
    ev = book.enrich(tape(spark, [LIFE[0], {"event_type": S.DELETE, "order_id": 1, "symbol": ""}]))
    assert [r["symbol"] for r in ev.orderBy("arrival").collect()] == ["X", "X"]
    assert book.with_tops(ev).where("arrival = 1").first()["bid_price"] is None


def test_engine_equals_delta_form(spark, small):
    ev = book_events(spark, small)
    assert book.oversize(ev).count() == 0
    assert book.reconcile(ev).count() == 0


def test_nbbo_may_cross(spark):
    rows = []
    for v, (bp, bq, ap, aq) in enumerate([(10_000, 200, 10_030, 150), (10_010, 100, 10_040, 90), (10_005, 75, 10_005, 80)]):
        rows += [{"venue": v, "order_id": 1, "side": 0, "price": bp, "qty": bq}, {"venue": v, "order_id": 2, "side": 1, "price": ap, "qty": aq}]
    last = nbbo.nbbo(tape(spark, rows)).orderBy(F.desc("arrival")).first()
    assert (last["bid_price"], last["bid_venue"], last["ask_price"], last["ask_venue"]) == (10_010, 1, 10_005, 2)


def quotes(spark, rows):
    cols = ["arrival", "symbol", "exchange_ts_ns", "event_type", "side", "qty", "price", "bid_price", "bid_qty", "ask_price", "ask_qty"]
    base = dict(symbol="X", exchange_ts_ns=0, event_type=0, side=2, qty=0, price=0)
    return spark.createDataFrame([tuple((base | {"arrival": k} | r)[c] for c in cols) for k, r in enumerate(rows)], "arrival long, symbol string, exchange_ts_ns long, event_type short, side short, qty long, price long, bid_price long, bid_qty long, ask_price long, ask_qty long")


def q(bp, bq, ap, aq, **k):
    return dict(bid_price=bp, bid_qty=bq, ask_price=ap, ask_qty=aq, **k)


def test_microprice(spark):
    r = quotes(spark, [q(10_000, 200, 10_200, 100)]).select(features.microprice().alias("m")).first()
    assert r["m"] == pytest.approx((10_200 * 200 + 10_000 * 100) / 300)


def test_ofi(spark):
    rows = [q(100, 50, 102, 30), q(101, 60, 102, 30, exchange_ts_ns=1), q(101, 60, 103, 20, exchange_ts_ns=2), q(101, 60, 103, 20, exchange_ts_ns=1_200_000_000)]
    f = quotes(spark, rows).withColumn("ofi_step", features.ofi_delta()).withColumn("ofi", features.trailing_sum("ofi_step", features.SECOND))
    assert [r["ofi"] for r in f.orderBy("arrival").collect()] == [0, 60, 90, 0]
    near = quotes(spark, rows[:2] + [rows[2] | {"exchange_ts_ns": 300_000_000}, rows[3]]).withColumn("ofi_step", features.ofi_delta()).withColumn("ofi", features.trailing_sum("ofi_step", features.SECOND))
    assert [r["ofi"] for r in near.orderBy("arrival").collect()] == [0, 60, 90, 30]


def test_trailing_sum_leaves_later_peers_out(spark):
    f = quotes(spark, [q(1, v, 9, 9, exchange_ts_ns=5) for v in (5, 6)]).select("arrival", features.trailing_sum("bid_qty", 10).alias("s"))
    assert [r["s"] for r in f.orderBy("arrival").collect()] == [5, 11]


def test_effective_spread_and_its_sql_form(spark):
    rows = [q(1000, 1, 1020, 1, event_type=7, side=0, qty=1, price=p) for p in (1012, 1008, 1016)]
    f = features.with_recursions(quotes(spark, rows)).orderBy("arrival").collect()
    assert [r["effective_spread"] for r in f] == pytest.approx([4.0, 4.0, 4.4])
    e = quotes(spark, rows).select("arrival", features.ema(2.0 * F.abs(F.col("price") - features.mid())).alias("e")).orderBy("arrival").collect()
    assert [r["e"] for r in e] == pytest.approx([4.0, 4.0, 4.4])


def test_kyle(spark):
    rows = [q(100, 1, 102, 1, event_type=7, side=0, qty=100, price=101), q(105, 1, 107, 1, event_type=7, side=0, qty=200, price=106)]
    f = features.with_kyle(quotes(spark, rows)).orderBy("arrival").collect()
    assert f[1]["kyle_lambda"] == pytest.approx((2 * 1000 - 300 * 5) / (2 * 50_000 - 300**2))


def test_vpin():
    r = features.Recursions()
    out = [r.step(True, side, qty, 100, 100.0)[1] for side, qty in ((0, 6000), (1, 4000), (1, 10_000))]
    assert out == pytest.approx([0.0, 0.2, 0.6])


def test_event_ofi(spark):
    rows = [dict(side=0, price=p, qty=n) for p, n in ((100, 10), (100, 12), (99, 8))] + [dict(side=1, price=p, qty=n) for p, n in ((101, 9), (101, 7), (102, 5))]
    assert features.event_ofi(tape(spark, rows)).orderBy(F.desc("arrival")).first()["ofi_events"] == -12


def test_features_do_not_look_ahead(spark, small):
    ev = book_events(spark, small)
    whole = features.features(nbbo.nbbo(ev)).where("arrival <= 800")
    part = features.features(nbbo.nbbo(ev.where("arrival <= 800")))
    assert whole.count() == part.count() > 100 and whole.exceptAll(part).count() == 0


def test_labels(spark):
    sec = research.SECOND
    rows = spark.createDataFrame([(k, "X", int(t * sec), float(m)) for k, (t, m) in enumerate(((0, 100), (0.5, 101), (1, 103), (5, 110), (10, 120)))], "arrival long, symbol string, exchange_ts_ns long, mid double")
    got = {(r["arrival"], r["horizon"] // sec): r["label"] for r in research.forward_labels(rows).collect()}
    assert [got[0, h] for h in (1, 5, 10)] == pytest.approx([0.03, 0.10, 0.20]) and got[4, 1] is None


def test_purged_folds(spark):
    sec = research.SECOND
    rows = spark.range(100).select(F.col("id").alias("arrival"), (F.col("id") * sec).alias("exchange_ts_ns"))
    a = research.purged_folds(rows)
    n = {(r["fold"], r["role"]): r["count"] for r in a.groupBy("fold", "role").count().collect()}
    assert all(n[f, "test"] == 20 and n[f, "train"] > 0 for f in range(5))
    assert all(r["n_leaks"] == 0 for r in research.leaks(a, sec).collect())
    assert sum(r["n_leaks"] for r in research.leaks(a, 5 * sec).collect()) > 0  # horizons beyond the purge do leak
    assert sum(r["n_leaks"] for r in research.leaks(research.purged_folds(rows, 2, 0, 0), sec).collect()) > 0


def test_global_rank_and_trailing(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 500, 700)
    df = spark.createDataFrame([(k, int(v)) for k, v in enumerate(x)], "k long, v long")
    ranked = ranks.global_rank(df, "v", ["k"])
    order = [r["k"] for r in ranked.orderBy("rank").collect()]
    assert order == sorted(range(700), key=lambda k: (x[k], k))
    t = ranks.trailing(ranked, "rank", 10, 64, {"s": F.sum("v")}).orderBy("rank").collect()
    s = np.array([x[k] for k in order])
    assert [r["s"] for r in t] == [int(s[max(0, i - 9) : i + 1].sum()) for i in range(700)]


def test_clock_over_all_events(spark):
    rng = np.random.default_rng(4)
    ts = (np.arange(400) * 10 - rng.integers(0, 60, 400)).clip(1).tolist()
    ev = tape(spark, [{"exchange_ts_ns": int(t), "venue": k % 3} for k, t in enumerate(ts)])
    want = [k > 0 and ts[k] < max(ts[:k]) for k in range(400)]
    assert [r["rejected"] for r in sequence.clock_filter(ev.repartition(5)).orderBy("arrival").collect()] == want


def test_zscore_blocks_do_not_matter(spark):
    rows = spark.range(500).select(F.col("id").alias("arrival"), F.lit("X").alias("symbol"), F.lit(0).cast("long").alias("exchange_ts_ns"), ((F.col("id") * 37) % 101).cast("double").alias("ofi"))
    a = research.with_zscore(rows, block=120).orderBy("arrival").collect()
    b = research.with_zscore(rows, by_symbol=True).orderBy("arrival").collect()
    assert [r["ofi_zscore"] for r in a] == pytest.approx([r["ofi_zscore"] for r in b])


def test_signals_registry(spark):
    reg = research.SignalRegistry()
    assert len(reg.signals) == 13
    reg.add("twice", lambda: F.col("ofi") * 2)
    with pytest.raises(ValueError):
        reg.add("ofi", lambda: F.lit(1))
    row = spark.createDataFrame([(1, "X", 1, 3.0, 10, 10, 5, 5, 10.5, 10.0)], "arrival long, symbol string, exchange_ts_ns long, ofi double, ask_price long, bid_price long, bid_qty long, ask_qty long, microprice double, mid double")
    got = {r["signal"]: r["value"] for r in reg.long(row, ["twice", "microprice_spread_adj", "sign_microprice_minus_mid", "bid_ask_imbalance"]).collect()}
    assert got == {"twice": 6.0, "microprice_spread_adj": 0.0, "sign_microprice_minus_mid": 1.0, "bid_ask_imbalance": 0.0}


def test_crossed_spread_traps(spark):
    row = spark.createDataFrame([(10, 12)], "ask_price long, bid_price long")
    assert row.select(research.spread()).first()[0] == -2 and row.select(research.spread(True)).first()[0] == (1 << 32) - 2


def test_short_positions_pay(spark):
    row = spark.createDataFrame([(-1.0, 0.2)], "q double, s double")
    strict, compat = (row.select(research.trading_cost(F.col("q"), F.col("s"), c)).first()[0] for c in (False, True))
    assert strict > 0 > compat


def test_pbo_and_bootstrap(spark):
    s = spark.createDataFrame([(f, i, o) for f, (x, y) in enumerate((([1, 0.8, 0.6], [0.2, 0.1, 0.0]), ([0.9, 0.7, 0.5], [0.3, 0.2, 0.1]))) for i, o in zip(map(float, x), map(float, y))], "fold int, is_score double, oos_score double")
    r = stats.overfit_probability(s).first()
    assert (r["comparisons"], r["pbo"]) == (2, 1.0) and stats.overfit_probability(s.limit(0)).first()["pbo"] == 0.5
    up = spark.createDataFrame([(k, v) for k, v in enumerate((1.0, 2.0, 1.5, 2.5, 1.0, 3.0))], "k int, v double")
    assert stats.bootstrap(up, "v", "k", 2, 500).first()["p_value"] < 0.05
    assert stats.bootstrap(up.select("k", F.lit(0.0).alias("v")), "v", "k", 2, 200).first()["p_value"] >= 0.5
    assert stats.bootstrap(up.limit(0), "v", "k", 2, 200).first()["p_value"] == 1.0


def test_risk_metrics(spark):
    r = spark.createDataFrame([(v,) for v in (1.0, -0.5, 0.5, -0.25)], "r double")
    e = spark.createDataFrame([(k, v) for k, v in enumerate((0.0, 1.0, 0.5, 1.5, 1.0))], "at long, equity double")
    t = spark.createDataFrame([(v,) for v in (2.0, -1.0, 1.0)], "pnl double")
    m = stats.risk_metrics(r, e, t).first()
    assert (m["max_drawdown"], m["win_rate"], m["avg_trade"]) == pytest.approx((0.5, 2 / 3, 2 / 3))
    mean, down = 0.1875, math.sqrt((0.25 + 0.0625) / 2)
    assert m["sortino"] == pytest.approx(mean / down)


def test_moments_of_equal_values(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert df.agg(stats.sharpe(F.col("x")), stats.skewness(F.col("x")), stats.excess_kurtosis(F.col("x")), stats.pearson(F.col("x"), F.col("x"))).first()[:] == (0.0, 0.0, 0.0, 0.0)


def test_deflated_sharpe_guards():
    assert stats.deflated_sharpe(1.0, 0, 3, 2, 10, 0.1)["p_value"] == 1.0
    assert stats.deflated_sharpe(0.5, 0.0, 3.0, 500, 10, 0.05)["p_value"] < 0.01


def test_matching():
    m = backtest.Matching(0.25)
    m.submit(1, 0, 100, 50, 1)
    assert m.event(S.TRADE, 1, 100, 100) == [(1, 0, 100, 25, True)]
    m = backtest.Matching(1.0)
    m.submit(1, 0, 100, 20, 1)
    m.submit(2, 0, 100, 20, 2)
    assert m.event(S.TRADE, 1, 100, 30) == [(1, 0, 100, 20, False), (2, 0, 100, 10, True)]
    m.cancel(2)
    assert m.event(S.TRADE, 1, 100, 30) == []
    m.submit(3, 1, 100, 10, 3)
    assert m.event(S.TRADE, 0, 100, 40) == [(3, 1, 100, 10, False)] and m.event(S.TRADE, 2, 100, 40) == []


def test_account():
    a = backtest.Account()
    a.fill(0, 100.0, 10, False)
    a.fill(1, 110.0, 15, True)
    a.mid = 105.0
    assert (a.position, a.realized, a.cost) == (-5, 100.0, 110.0)
    assert a.equity == pytest.approx(-1000 + 1650 - 5 * 105) and a.fees == pytest.approx(0.045)
    c = backtest.Account(compat=True)
    c.fill(0, 100.0, 10, False)
    c.mid = 101.0
    assert c.equity == pytest.approx(-1000 + 10)


def test_simulation_conserves(spark, small):
    ticks = backtest.simulate(book_events(spark, small), backtest.Config("market_maker", {"half_spread": 2}, 0.5))
    f, a = backtest.fills(ticks), backtest.final_accounts(ticks)
    i = backtest.intents(ticks)
    assert i.where("action = 'submit'").count() == a.agg(F.sum("submitted")).first()[0] and i.where("action = 'cancel'").count() == a.agg(F.sum("cancelled")).first()[0]
    assert backtest.output_hash(ticks).first() == backtest.output_hash(ticks.repartition(3)).first()
    net = {r["symbol"]: r["n"] for r in f.groupBy("symbol").agg(F.sum(F.when(F.col("side") == 0, F.col("qty")).otherwise(-F.col("qty"))).alias("n")).collect()}
    assert f.count() > 10 and all(net.get(r["symbol"], 0) == r["position"] for r in a.collect())
    last = backtest.equity_curve(ticks).orderBy(F.desc("arrival")).first()["equity"]
    assert last == pytest.approx(a.agg(F.sum("equity")).first()[0])


def test_four_event_tape(spark):
    rows = [LIFE[0] | {"price": 100}, LIFE[1] | {"price": 102}, {"event_type": S.TRADE, "side": 1, "price": 100, "qty": 120}, {"event_type": S.TRADE, "side": 0, "price": 102, "qty": 120}]
    r = backtest.report(backtest.simulate(tape(spark, rows))).first()
    assert r["submitted"] >= 2 and r["fills"] == 2 and r["realized"] >= 0


def test_service(spark, small):
    ev = book_events(spark, small)
    assert service.stream_ticks(ev, "SYM1", limit=5).count() == 5 and service.stream_ticks(ev).count() == ev.count()
    quotes_ = nbbo.changes(nbbo.nbbo(ev))
    cat = service.Catalog(ev, quotes_)
    first = quotes_.where("symbol = 'SYM1'").orderBy("arrival").first()
    assert not cat.nbbo("SYM1", 1)["found"] and cat.nbbo("SYM1", first["exchange_ts_ns"])["arrival"] == first["arrival"]
    assert cat.health()["book_records"] == ev.count() and len(list(cat.ticks("SYM1", limit=3))) == 3


def test_asof_first_of_equal_times_wins(spark):
    right = spark.createDataFrame([("X", 10, 1, 5), ("X", 10, 2, 6), ("X", 20, 3, 7)], "symbol string, exchange_ts_ns long, arrival long, v long")
    left = spark.createDataFrame([("X", 9), ("X", 10), ("X", 25), ("Y", 25)], "symbol string, ts long")
    got = {(r["symbol"], r["ts"]): (r["v"], r["found"]) for r in nbbo.asof(left, right, ["v"]).collect()}
    assert got == {("X", 9): (None, False), ("X", 10): (5, True), ("X", 25): (7, True), ("Y", 25): (None, False)}


def test_results_do_not_depend_on_partitions(spark, small):
    out = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        f = features.features(nbbo.nbbo(book_events(spark, small).repartition(n)))
        out.append(sorted(map(tuple, f.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert out[0] == out[1]


def test_synthetic_books(spark):
    t = synthetic.lifecycle_tape(spark, 400)
    assert t.groupBy("venue", "sequence").count().where("count > 1").count() == 0
    r = synthetic.research_tape(spark, 60, 2)
    assert book.live_levels(book.enrich(r)).count() == 0 and r.where("event_type = 7").count() == 20
    d = synthetic.dual_feed(t, 0.3, 0.0)
    assert sequence.arbitrate(d).count() == 400 and d.where("feed = 'A'").count() < 400


def test_queries_have_oracles():
    from tapeloom.plans import catalogue

    assert len(catalogue.queries()) > 60 and set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_decoders_on_hand_built_bytes(spark):
    ts = (34_200_000_000_000).to_bytes(6, "big")
    head = b"\x00\x01\x00\x02" + ts
    itch = [
        b"A" + head + (77).to_bytes(8, "big") + b"B" + (100).to_bytes(4, "big") + b"AAPL    " + (1_500_000).to_bytes(4, "big"),
        b"F" + head + (78).to_bytes(8, "big") + b"S" + (50).to_bytes(4, "big") + b"MSFT    " + (99).to_bytes(4, "big") + b"ABCD",
        b"E" + head + (77).to_bytes(8, "big") + (30).to_bytes(4, "big") + (9).to_bytes(8, "big"),
        b"U" + head + (77).to_bytes(8, "big") + (79).to_bytes(8, "big") + (10).to_bytes(4, "big") + (11).to_bytes(4, "big"),
        b"Z" + head,
        b"D" + head,
        b"",
    ]
    df = decode.as_messages(spark.createDataFrame([(k, bytearray(m)) for k, m in enumerate(itch)], "arrival long, payload binary"))
    got = {r["arrival"]: r for r in decode.decode(df, decode.ITCH).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert (got[0]["symbol"], got[0]["order_id"], got[0]["side"], got[0]["qty"], got[0]["price"], got[0]["exchange_ts_ns"]) == ("AAPL", 77, 0, 100, 1_500_000, 34_200_000_000_000)
    assert (got[1]["mpid"], got[1]["event_type"], got[1]["side"]) == ("ABCD", S.ADD_MPID, 1)
    assert (got[2]["match_id"], got[2]["qty"]) == (9, 30) and (got[3]["reference_order_id"], got[3]["order_id"]) == (77, 79)
    assert (got[4]["event_type"], got[4]["status"]) == (S.UNKNOWN_TYPE, "unknown")
    assert {(chr(r["raw_type"]), r["status"]) for r in decode.parse_stats(df, decode.ITCH).collect() if r["raw_type"]} >= {("D", "malformed"), ("A", "ok")}

    pitch = [b"28800168A1K27GA00000YS000100AAPL  0001831900Y", b"28800169d1K27GA00000ZB000200AAPL    0001831900YMPIDC", b"28800170X1K27GA00000Y000100", b"28800171E1K27GA00000Y0001001K27GA00000K", b"2880017", b"2880A171X1K27ga00000Y0001x0"]
    got = {r["arrival"]: r for r in decode.decode(decode.as_messages(spark.createDataFrame([(k, bytearray(m)) for k, m in enumerate(pitch)], "arrival long, payload binary")), decode.PITCH).collect()}
    assert sorted(got) == [0, 1, 2, 3, 5]
    assert (got[0]["order_id"], got[0]["price"], got[0]["qty"], got[0]["side"], got[0]["exchange_ts_ns"]) == (int("1K27GA00000Y", 36), 1_831_900, 100, 1, 28_800_168_000_000)
    assert got[1]["mpid"] == "MPID" and got[3]["match_id"] == int("1K27GA00000K", 36)
    assert (got[5]["order_id"], got[5]["qty"], got[5]["exchange_ts_ns"]) == (0, 0, 0)

    le = lambda v, n: v.to_bytes(n, "little")
    deep = [b"a8" + le(5, 8) + b"IBM     " + le(12, 8) + le(300, 4) + le(1 << 40, 8), b"T\x00" + le(6, 8) + b"IBM     " + le(7, 4) + le(123, 8) + le(44, 8), b"H\x00", b"R\x00"]
    got = {r["arrival"]: r for r in decode.decode(decode.as_messages(spark.createDataFrame([(k, bytearray(m)) for k, m in enumerate(deep)], "arrival long, payload binary")), decode.DEEP).collect()}
    assert (got[0]["price"], got[0]["side"], got[0]["symbol"]) == (S.U32, 0, "IBM") and (got[1]["match_id"], got[1]["qty"]) == (44, 7)
    assert got[2]["status"] == "unknown" and 3 not in got


def entry(price, qty, sec, rpt, action, kind):
    return price.to_bytes(8, "little", signed=True) + qty.to_bytes(4, "little", signed=True) + sec.to_bytes(4, "little") + rpt.to_bytes(4, "little") + bytes(5) + bytes([action]) + kind.encode() + bytes(5)


def test_sbe_packets(spark):
    body = (999).to_bytes(8, "little") + bytes(3) + (32).to_bytes(2, "little") + bytes([3]) + entry(4_500_00000, 5, 42, 7, 0, "0") + entry((1 << 63) - 1, -1, 42, 0, 2, "1") + entry(1, 1, 42, 8, 0, "J")
    msg = (10 + len(body)).to_bytes(2, "little") + (11).to_bytes(2, "little") + (32).to_bytes(2, "little") + bytes(4) + body
    packet = (3).to_bytes(4, "little") + (1000).to_bytes(8, "little") + msg
    assert decode.sbe_packet(packet) == [(S.ADD, 7, 999, "42", 5, 4500, 0), (S.DELETE, 3 << 32 | 1, 999, "42", 0, 0, 1)]
    df = spark.createDataFrame([(1, bytearray(packet), 5), (2, bytearray(b"xx"), 5)], "arrival long, payload binary, ingest_ts_ns long")
    assert [(r["arrival"], r["order_id"]) for r in decode.decode_sbe(df).orderBy("arrival").collect()] == [(256, 7), (257, 3 << 32 | 1)]
    cert = bytes(8) + len(packet).to_bytes(2, "big") + packet + bytes(10) + bytes(8) + b"\x00\x09x"
    assert list(files.walk_cert(cert)) == [packet]


def test_random_bytes_never_raise(spark):
    rng = np.random.default_rng(9)
    rows = [(k, bytearray(rng.integers(0, 256, rng.integers(0, 70)).astype(np.uint8).tobytes())) for k in range(300)]
    rows += [(300 + k, bytearray(t.encode() + bytes(rng.integers(0, 256, 60).astype(np.uint8)))) for k, t in enumerate("AFECXDUPQISR")]
    df = decode.as_messages(spark.createDataFrame(rows, "arrival long, payload binary"))
    for layout in decode.LAYOUTS.values():
        assert decode.decode(df, layout, True).count() == len(rows)
        decode.decode(df, layout, True).collect()
    for _, b in rows:
        decode.sbe_packet(bytes(b))
        for p in ("itch", "deep", "pitch"):
            files.frame(bytes(b), p)


def test_framing_round_trip(spark):
    messages = [bytes([65 + k % 20]) * (1 + k % 50) for k in range(70)]
    grams = files.pack_mold(messages, first=11)
    assert all(len(g) <= 1400 for g in grams)
    df = spark.createDataFrame([(k, 0, bytearray(g)) for k, g in enumerate(grams)], "arrival long, ingest_ts_ns long, payload binary")
    got = files.framed(df, "itch").orderBy("sequence").collect()
    assert [bytes(r["payload"]) for r in got] == messages and [r["sequence"] for r in got] == list(range(11, 81))
    assert files.frame(b"12345678Axx\n\nshort\n", "pitch") == [(12345678, b"12345678Axx"), (0, b"short")]


def test_journal_round_trip_and_damage(spark, small, tmp_path):
    ev = book_events(spark, small).where("arrival < 700")
    path = str(tmp_path / "j")
    n = files.write_journal(ev, path, parts=3)
    assert n == ev.count() == files.count_records(path)
    back = files.read_journal(spark, path, records=100)
    cells = [c for c in S.COLUMNS if c != "arrival"]
    assert back.select(cells).exceptAll(ev.select(cells)).count() == 0 and back.count() == n
    assert [r["sequence"] for r in back.where("venue = 1").orderBy("arrival").collect()] == [r["sequence"] for r in ev.where("venue = 1").orderBy("arrival").collect()]
    assert files.write_journal(ev, path, parts=2, append=True) == n and files.count_records(path) == 2 * n
    one = str(tmp_path / "one")
    files.write_journal(ev, one, parts=1)
    (f,) = [p for p in (tmp_path / "one").iterdir() if not p.name.startswith(".")]
    raw = bytearray(f.read_bytes())
    assert len(raw) == 8 + n * 112
    raw[8 + 112 * 3 + 30] ^= 1
    f.write_bytes(bytes(raw) + b"torn")
    assert files.read_journal(spark, one).count() == n - 1
    bad = {r["status"]: r["count"] for r in files.read_journal(spark, one, permissive=True).groupBy("status").count().collect()}
    assert bad == {"ok": n - 1, "record_crc": 1, "unexpected_eof": 1}
    with pytest.raises(ValueError):
        files.count_records(one)
    f.write_bytes(b"MFJN\x02\x00\x00\x00" + bytes(raw[8:]))
    with pytest.raises(Exception, match="journal"):
        files.read_journal(spark, one).count()


def test_nbbo_journal(spark, small, tmp_path):
    quotes_ = nbbo.journal(book_events(spark, small))
    files.write_journal(quotes_, str(tmp_path / "n"), "nbbo", parts=2)
    back = files.read_journal(spark, str(tmp_path / "n"), "nbbo")
    cells = ["symbol", "exchange_ts_ns", "bid_price", "bid_qty", "ask_price", "ask_qty"]
    assert back.count() == quotes_.count() and back.select(cells).exceptAll(quotes_.select(cells)).count() == 0


def test_captures(spark, tmp_path):
    messages = [b"S" + bytes(11), b"D" + bytes(18)]
    (tmp_path / "a.bin").write_bytes(b"".join(len(m).to_bytes(2, "big") + m for m in (messages[0], b"", messages[1])) + b"\x00\x50zz")
    got = files.read_capture(spark, str(tmp_path / "a.bin")).orderBy("arrival").collect()
    assert [bytes(r["payload"]) for r in got] == messages
    assert files.read_capture(spark, str(tmp_path / "a.bin"), max_events=1).count() == 1
    assert list(files.walk_raw_itch(b"".join(messages))) == messages
    with pytest.raises(ValueError):
        list(files.walk_raw_itch(b"?"))
    ip = b"\x45" + bytes(8) + b"\x11" + bytes(10)
    body = bytes(40) + len(messages[1]).to_bytes(2, "little") + messages[1]
    packet = bytes(12) + b"\x08\x00" + ip + bytes(8) + body
    pcap = b"\xd4\xc3\xb2\xa1" + bytes(20) + bytes(8) + len(packet).to_bytes(4, "little") * 2 + packet
    assert list(files.walk_pcap(pcap)) == [messages[1]]
    assert files.looks_like_text(b"a,b,c\n" * 50) and not files.looks_like_text(pcap)


def test_time_forward_fill(spark):
    ev = tape(spark, [{"exchange_ts_ns": t} for t in (0, 5, 0, 7)])
    assert [r["exchange_ts_ns"] for r in sequence.forward_fill_time(ev, ["venue"]).orderBy("arrival").collect()] == [0, 5, 5, 7]


def frames(spark, texts):
    return spark.createDataFrame([(k, "tBTCUSD", k, t) for k, t in enumerate(texts)], "arrival long, symbol string, exchange_ts_ns long, frame string")


def test_crypto_frames(spark):
    f = frames(spark, ['{"event":"info"}', "[1,[5,10.0,1.0],9]", "[1,[[5,100.5,2.0],[6,101,-1]],10]", '[1,"hb"]', "[1,[5,100.6,1.0],11]", "[1,[6,0,-1],12]", "[1,[9,0,1],13]", "[1,[7,-5,1],14]", "[1,[7,5,1],20]", "[1,[7,5,1],21]", "[1,[],0]", "garbage"])
    p = crypto.parse_frames(f)
    assert [r["kind"] for r in p.orderBy("arrival").collect()] == ["control", "update", "snapshot", "heartbeat", "update", "update", "update", "update", "update", "update", "snapshot", "malformed"]
    assert crypto.sync_stats(p).first().asDict() == {"symbol": "tBTCUSD", "snapshots": 2, "gaps": 1, "ignored": 2, "applied": 4}
    low = crypto.lower(crypto.synced(p)).orderBy("arrival").collect()
    assert [(r["event_type"], r["order_id"], r["price"], r["qty"], r["side"], r["status"]) for r in low] == [
        (S.ADD, 5, 1_005_000, 2_000_000, 0, "ok"), (S.ADD, 6, 1_010_000, 1_000_000, 1, "ok"), (S.REPLACE, 5, 1_006_000, 1_000_000, 0, "ok"), (S.CANCEL, 6, 0, 0, 1, "ok"), (S.CANCEL, 9, 0, 0, 0, "skipped"), (S.ADD, 7, None, 1_000_000, 0, "rejected"),
    ]
    assert low[2]["prev_price"] == 1_005_000


def test_codecs(spark):
    from tapeloom.functions import codecs as c

    df = spark.createDataFrame([("AAPL", "1K", 1_234_567), ("A", "bad", 1 << 40)], "s string, k string, t long")
    got = df.select(c.u64_to_symbol(c.symbol_to_u64(F.col("s"))), c.base36(F.col("k")), c.rescale(F.col("t"), 6), c.display_price(F.col("t")).cast("string")).collect()
    assert [tuple(r) for r in got] == [("AAPL", 56, 12_345, "123.4567"), ("A", 0, S.U32, "109951162.7776")]
    assert df.select(c.symbol_to_u64(F.col("s")).alias("x")).first()["x"] == int.from_bytes(b"AAPL    ", "big")


def test_sidecar(spark, tmp_path):
    p = crypto.parse_frames(frames(spark, ["[1,[[5,100.5,2.0]],10]"]))
    crypto.write_sidecar(p, str(tmp_path / "s"))
    r = crypto.read_sidecar(spark, str(tmp_path / "s")).first()
    assert r["cut_sequence"] == 10 and r["rows"][0]["price"] == 100.5
