"""Queries of tape, book, quotes and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.operators import book, features, nbbo, sequence, service
from tapeloom.sources.adapter import TAPE_SQL, book_events

HOUR = 3_600_000_000_000
#: Events of the provided tape are minutes apart, so windows are an hour where a live tape has a second.
WINDOW = HOUR

LEVELS_SQL = """
own AS (SELECT order_id, symbol, side, price, qty FROM ev WHERE event_type = 0),
dl AS (SELECT e.arrival, e.venue, o.symbol, o.side, o.price, e.event_type, e.order_id,
    CASE WHEN e.event_type = 0 THEN e.qty WHEN e.event_type = 5 THEN -(o.qty - coalesce(sum(CASE WHEN e.event_type IN (2,
        4) THEN e.qty END) OVER (PARTITION BY e.order_id ORDER BY e.arrival), 0)) ELSE -e.qty END delta
    FROM ev e JOIN own o ON o.order_id = e.order_id WHERE e.event_type IN (0, 2, 4, 5)),
lv AS (SELECT *, CAST(sum(delta) OVER w AS BIGINT) depth, lead(arrival) OVER w nxt FROM dl WINDOW w AS (PARTITION BY venue, symbol, side, price
        ORDER BY arrival))"""

TOPS_SQL = LEVELS_SQL + """,
best AS (SELECT e.arrival, max(CASE WHEN l.side = 0 THEN l.price END) bid, arg_max(l.depth, CASE WHEN l.side = 0 THEN l.price END) bq,
    min(CASE WHEN l.side = 1 THEN l.price END) ask, arg_min(l.depth, CASE WHEN l.side = 1 THEN l.price END) aq
    FROM ev e JOIN lv l ON l.venue = e.venue AND l.symbol = e.symbol AND l.arrival <= e.arrival AND (l.nxt IS NULL OR l.nxt > e.arrival)
        AND l.depth > 0 GROUP BY e.arrival),
tops AS (SELECT e.*, b.bid, b.bq, b.ask, b.aq, coalesce(l.depth - l.delta, 0) queue_ahead
    FROM ev e LEFT JOIN best b USING (arrival) LEFT JOIN (SELECT arrival, depth, delta FROM lv WHERE event_type = 0) l ON l.arrival = e.arrival)"""

_V = range(5)
NBBO_SQL = TOPS_SQL + f""",
vs AS (SELECT *, {", ".join(f"last_value(CASE WHEN venue = {v} THEN {{'bid': bid, 'bq': bq, 'ask': ask, 'aq': aq}} END IGNORE NULLS) OVER w v{v}" for v in _V)} FROM tops
    WINDOW w AS (PARTITION BY symbol ORDER BY arrival ROWS UNBOUNDED PRECEDING)),
ks AS (SELECT *, list_max([{", ".join(f"v{v}.bid * 8 + {7 - v}" for v in _V)}]) bk, list_min([{", ".join(f"v{v}.ask * 8 + {v}" for v in _V)}]) ak FROM vs),
nb AS (SELECT arrival, venue, symbol, event_type, ns, seq, side, price, qty, queue_ahead, bk // 8 bid_price,
        CASE 7 - bk % 8 {" ".join(f"WHEN {v} THEN v{v}.bq" for v in _V)} END bid_qty, 7 - bk % 8 bid_venue,
    ak // 8 ask_price, CASE ak % 8 {" ".join(f"WHEN {v} THEN v{v}.aq" for v in _V)} END ask_qty, ak % 8 ask_venue FROM ks)"""
TWO_SQL = NBBO_SQL + """,
two AS (SELECT *, (bid_price + ask_price) / 2.0 AS mid FROM nb WHERE bid_price IS NOT NULL AND ask_price IS NOT NULL)"""
OFI_SQL = TWO_SQL + """,
ofi1 AS (SELECT *, CAST(coalesce(CASE WHEN bid_price > pb THEN bid_qty WHEN bid_price < pb THEN -pbq ELSE bid_qty - pbq END + CASE
        WHEN ask_price < pa THEN -ask_qty WHEN ask_price > pa THEN paq ELSE paq - ask_qty END, 0) AS BIGINT) ofi_step
    FROM (SELECT *, lag(bid_price) OVER w pb, lag(bid_qty) OVER w pbq, lag(ask_price) OVER w pa, lag(ask_qty) OVER w paq FROM two
        WINDOW w AS (PARTITION BY symbol ORDER BY arrival))),
ofi2 AS (SELECT *, CAST(sum(ofi_step) OVER (PARTITION BY symbol ORDER BY arrival ROWS UNBOUNDED PRECEDING)
    - coalesce(sum(ofi_step) OVER (PARTITION BY symbol ORDER BY ns RANGE BETWEEN UNBOUNDED PRECEDING AND %d PRECEDING), 0) AS BIGINT) ofi
        FROM ofi1)""" % (WINDOW + 1)


def tape_sql(parts: str, select: str) -> str:
    """The tape's WITH clause, further entries (with or without a leading comma) and a query."""
    parts = parts.strip().lstrip(",")
    return f"WITH {TAPE_SQL}{',' if parts else ''}{parts}\n{select}"


QUOTED = ["arrival", "venue", "symbol", "event_type", "exchange_ts_ns", "ingest_ts_ns", "side", "qty", "price"]


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    return nbbo.nbbo(book_events(spark, d), keep=QUOTED)


def stream_ticks(spark, d):
    lo, hi = 1_704_153_600_000_000_000, 1_705_363_200_000_000_000
    return service.stream_ticks(book_events(spark, d), "SYM3", lo, hi, 500).select("arrival", "venue", "symbol", "event_type", "exchange_ts_ns", "order_id", "price", "qty")


def stream_nbbo(spark, d):
    return service.stream_nbbo(nbbo.changes(_quotes(spark, d)), "SYM2", 0, 0, 200).select("arrival", "symbol", "exchange_ts_ns", "bid_price", "bid_qty", "ask_price", "ask_qty")


def catalog_health(spark, d):
    return service.health(book_events(spark, d), nbbo.changes(_quotes(spark, d)))


def event_type_counts(spark, d):
    return book_events(spark, d).groupBy("venue", "event_type").agg(F.count("*").alias("n"), F.sum("qty").alias("total_qty"))


def store_stats(spark, d):
    return service.store_stats(book_events(spark, d))


def ts_forward_fill(spark, d):
    ev = book_events(spark, d).select("arrival", "venue", F.when(F.col("arrival") % 3 == 0, 0).otherwise(F.col("exchange_ts_ns")).alias("exchange_ts_ns"))
    return sequence.forward_fill_time(ev, by=["venue"])


def clock_rejects(spark, d):
    return sequence.clock_filter(_jittered(book_events(spark, d)), by=["venue"]).groupBy("venue", "rejected").agg(F.count("*").alias("n"), F.min("exchange_ts_ns").alias("min_ts"), F.max("exchange_ts_ns").alias("max_ts"))


def _jittered(ev: DataFrame) -> DataFrame:
    return ev.withColumn("exchange_ts_ns", F.col("exchange_ts_ns") - F.when(F.col("arrival") % 5 == 0, F.lit(2 * HOUR)).otherwise(0))


def _copies(ev: DataFrame) -> DataFrame:
    """Feeds A and B of one tape: A loses sequences divisible by 7, B those divisible by 5; B arrives behind A."""
    a = ev.where("sequence % 7 <> 0").withColumn("feed", F.lit("A")).withColumn("arrival", F.col("arrival") * 2)
    b = ev.where("sequence % 5 <> 0").withColumn("feed", F.lit("B")).withColumn("arrival", F.col("arrival") * 2 + 1)
    return a.unionByName(b)


def first_wins_dedupe(spark, d):
    return sequence.arbitrate(_copies(book_events(spark, d))).select("venue", "sequence", "feed", "arrival", "order_id")


def gap_report(spark, d):
    return sequence.gap_report(sequence.arbitrate(_copies(book_events(spark, d)))).select("venue", "gap_begin", "gap_end", "missing")


def deterministic_merge(spark, d):
    merged = sequence.merge_order(_jittered(book_events(spark, d)))
    return merged.select("merge_rank", "arrival", "venue", "sequence", "exchange_ts_ns")


def _other(ev: DataFrame) -> DataFrame:
    return ev.where("sequence % 97 <> 0").withColumn("qty", F.when(F.col("sequence") % 101 == 0, F.col("qty") + 1).otherwise(F.col("qty")))


def journal_diff(spark, d):
    ev = book_events(spark, d)
    return sequence.diff(ev, _other(ev), ["venue", "sequence"], ["symbol", "order_id", "qty", "price"]).select("venue", "sequence", "difference")


def stream_divergence(spark, d):
    ev = book_events(spark, d)
    return sequence.divergence(ev, _other(ev), ["venue", "sequence"], ["symbol", "order_id", "qty", "price"])


def book_levels(spark, d):
    return book.levels(book_events(spark, d)).select("arrival", "venue", "symbol", "side", "price", "delta", "depth")


def queue_ahead(spark, d):
    return book.levels(book_events(spark, d)).where("event_type IN (0, 1)").select("arrival", "order_id", F.col("ahead").alias("queue_ahead"))


def top_of_book(spark, d):
    return book.top_of_book(book_events(spark, d))


def depth_snapshot(spark, d):
    snap = book.depth_snapshot(book_events(spark, d))
    cells = F.array_join(F.transform("levels", lambda c: F.concat(c["price"].cast("string"), F.lit("x"), c["qty"].cast("string"))), ",")
    return snap.select("venue", "symbol", "side", F.size("levels").cast("long").alias("n_levels"), cells.alias("levels"))


def book_reconcile(spark, d):
    """Levels on which the engine and the delta form differ, beside the number and depth of those that they share by venue."""
    ev = book_events(spark, d)
    levels = book.live_levels(ev).groupBy("venue").agg(F.count("*").alias("n_levels"), F.sum("qty").alias("depth"))
    apart = book.reconcile(ev).groupBy("venue").agg(F.count("*").alias("differences"))
    return levels.join(apart, "venue", "left").select("venue", "n_levels", "depth", F.coalesce("differences", F.lit(0)).alias("differences"))


def book_tops(spark, d):
    return book.with_tops(book_events(spark, d), keep=["arrival", "venue", "symbol"]).select("arrival", "venue", "symbol", "bid_price", "bid_qty", "ask_price", "ask_qty", "queue_ahead")


def nbbo_consolidated(spark, d):
    return _quotes(spark, d).select("arrival", "symbol", *nbbo.BBO)


def nbbo_changes(spark, d):
    return nbbo.changes(_quotes(spark, d)).select("arrival", "symbol", *nbbo.BBO)


def nbbo_journal(spark, d):
    return nbbo.journal(book_events(spark, d)).select("arrival", "symbol", "venue", *nbbo.BBO)


def nbbo_asof(spark, d):
    """The quote in force at every hour of every symbol: the bulk form of the point query."""
    ev = book_events(spark, d)
    hours = ev.agg(F.floor(F.min("exchange_ts_ns") / HOUR).alias("lo"), F.floor(F.max("exchange_ts_ns") / HOUR).alias("hi"))
    symbols = ev.select("symbol").distinct().join(F.broadcast(hours))  # one row
    grid = symbols.select("symbol", F.explode(F.sequence("lo", F.col("hi") + 1)).alias("h")).select((F.col("h") * HOUR).alias("ts"), "symbol")
    quotes = nbbo.changes(nbbo.nbbo(ev, keep=QUOTED))
    return nbbo.asof(grid, quotes, ["bid_price", "bid_qty", "ask_price", "ask_qty"]).select("symbol", "ts", "bid_price", "bid_qty", "ask_price", "ask_qty", "quote_ts", "found")


def microprice(spark, d):
    return features.two_sided(_quotes(spark, d)).select("arrival", "symbol", features.mid().alias("mid"), F.round(features.microprice(), 6).alias("microprice"))


def ofi_delta(spark, d):
    return features.two_sided(_quotes(spark, d)).select("arrival", "symbol", features.ofi_delta().alias("ofi_delta"))


def ofi_window(spark, d):
    q = features.two_sided(_quotes(spark, d)).withColumn("ofi_step", features.ofi_delta())
    return q.select("arrival", "symbol", features.trailing_sum("ofi_step", WINDOW).alias("ofi"))


def ofi_events128(spark, d):
    return features.event_ofi(book_events(spark, d)).select("arrival", "symbol", "ofi_events")


def effective_spread_ema(spark, d):
    q = features.with_recursions(features.two_sided(_quotes(spark, d)))
    return q.select("arrival", "symbol", F.round("effective_spread", 6).alias("effective_spread"))


def kyle_lambda(spark, d):
    return features.with_kyle(features.two_sided(_quotes(spark, d))).select("arrival", "symbol", F.round("kyle_lambda", 8).alias("kyle_lambda"))


VPIN_VOLUME = 200


def vpin(spark, d):
    q = features.with_recursions(features.two_sided(_quotes(spark, d)), VPIN_VOLUME)
    return q.where("event_type IN (7, 8)").select("arrival", "symbol", F.round("vpin", 9).alias("vpin"))


def feature_rows(spark, d):
    f = features.features(_quotes(spark, d), WINDOW)
    return f.select("arrival", "symbol", F.round("microprice", 6).alias("microprice"), "ofi", "queue_ahead", F.round("kyle_lambda", 8).alias("kyle_lambda"), "bid_price", "ask_price")


QUERIES = {f.__name__: f for f in (
    nbbo_asof, stream_ticks, stream_nbbo, catalog_health, event_type_counts, store_stats, ts_forward_fill, clock_rejects, first_wins_dedupe, gap_report, deterministic_merge, journal_diff, stream_divergence,
    book_levels, queue_ahead, top_of_book, depth_snapshot, book_reconcile, book_tops, nbbo_consolidated, nbbo_changes, nbbo_journal, microprice, ofi_delta, ofi_window, ofi_events128, effective_spread_ema, kyle_lambda, vpin, feature_rows,
)}

_CHANGES = NBBO_SQL + """,
ch AS (SELECT * FROM (SELECT *, row_number() OVER w first_row, lag({'a': bid_price, 'b': bid_qty, 'c': bid_venue, 'd': ask_price, 'e': ask_qty,
        'f': ask_venue}) OVER w was FROM nb WINDOW w AS (PARTITION BY symbol ORDER BY arrival))
    WHERE (first_row > 1 AND was IS DISTINCT FROM {'a': bid_price, 'b': bid_qty, 'c': bid_venue, 'd': ask_price, 'e': ask_qty,
        'f': ask_venue}) OR (first_row = 1 AND (bid_price IS NOT NULL OR ask_price IS NOT NULL)))"""
_JIT = ", jit AS (SELECT * REPLACE (CASE WHEN arrival % 5 = 0 THEN ns - 7200000000000 ELSE ns END AS ns) FROM ev)"
_COPIES = """, copies AS (SELECT venue, seq, 'A' feed, arrival * 2 arrival, order_id FROM ev WHERE seq % 7 <> 0 UNION ALL
        SELECT venue, seq, 'B', arrival * 2 + 1, order_id FROM ev WHERE seq % 5 <> 0),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY venue, seq ORDER BY arrival) rn FROM copies) WHERE rn = 1)"""
_OTHER = ", other AS (SELECT * REPLACE (CASE WHEN seq % 101 = 0 THEN qty + 1 ELSE qty END AS qty) FROM ev WHERE seq % 97 <> 0)"
_DIFF = _OTHER + """, df AS (SELECT coalesce(a.venue, b.venue) venue, coalesce(a.seq, b.seq) AS sequence, CASE WHEN b.seq IS NULL THEN 'left only'
        WHEN a.seq IS NULL THEN 'right only' ELSE 'changed' END difference
    FROM ev a FULL JOIN other b ON a.venue = b.venue AND a.seq = b.seq WHERE a.seq IS NULL OR b.seq IS NULL OR (a.symbol, a.order_id, a.qty,
        a.price) IS DISTINCT FROM (b.symbol, b.order_id, b.qty, b.price))"""
_KYLE = TWO_SQL + """,
kx AS (SELECT *, CASE WHEN event_type IN (7, 8) THEN CASE side WHEN 0 THEN qty WHEN 1 THEN -qty ELSE 0 END END x, CASE
        WHEN event_type IN (7, 8) THEN coalesce((bid_price + ask_price) - lag(bid_price + ask_price) OVER (PARTITION BY symbol ORDER BY arrival), 0) END y
        FROM two),
ky AS (SELECT *, CAST(count(x) OVER w AS DOUBLE) n, CAST(sum(x) OVER w AS DOUBLE) sx, CAST(sum(y) OVER w AS DOUBLE) sy, CAST(sum(x * x) OVER w AS DOUBLE) sxx,
        CAST(sum(x * y) OVER w AS DOUBLE) sxy FROM kx WINDOW w AS (PARTITION BY symbol ORDER BY arrival ROWS UNBOUNDED PRECEDING)),
kl AS (SELECT arrival, symbol, round(kyle_raw, 8) kyle_lambda, kyle_raw FROM (SELECT *, coalesce(CASE
        WHEN abs(n * sxx - sx * sx) > 1e-12 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) / 2.0 END, 0.0) kyle_raw FROM ky))"""
_MICRO = "round(CASE WHEN bid_qty + ask_qty > 0 THEN CAST(ask_price * bid_qty + bid_price * ask_qty AS DOUBLE) / (bid_qty + ask_qty) ELSE mid END, 6)"
_BBO = "bid_price, bid_qty, bid_venue, ask_price, ask_qty, ask_venue"
_STATS = "count(*) records, min(ns) min_ts, max(ns) max_ts, arg_min(ns, arrival) first_ts, arg_max(ns, arrival) last_ts"

ORACLE_SQL = {
    "nbbo_asof": tape_sql(_CHANGES + """, grid AS (SELECT h * 3600000000000 ts, symbol FROM (SELECT unnest(range(min(ns) // 3600000000000,
        max(ns) // 3600000000000 + 2)) h FROM ev), (SELECT DISTINCT symbol FROM ev)),
        q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ns ORDER BY arrival) rn FROM ch) WHERE rn = 1)""",
        "SELECT g.symbol, g.ts, q.bid_price, q.bid_qty, q.ask_price, q.ask_qty, q.ns quote_ts, q.ns IS NOT NULL AS found FROM grid g ASOF LEFT "
            "JOIN q ON q.symbol = g.symbol AND q.ns <= g.ts"),
    "stream_ticks": tape_sql("", "SELECT arrival, venue, symbol, event_type, ns exchange_ts_ns, order_id, price, qty FROM ev WHERE symbol = 'SYM3' "
        "AND ns BETWEEN 1704153600000000000 AND 1705363200000000000 ORDER BY arrival LIMIT 500"),
    "stream_nbbo": tape_sql(_CHANGES, "SELECT arrival, symbol, ns exchange_ts_ns, bid_price, bid_qty, ask_price, ask_qty FROM ch WHERE symbol = 'SYM2' "
        "ORDER BY arrival LIMIT 200"),
    "catalog_health": tape_sql(_CHANGES, "SELECT 'SERVING' status, (SELECT count(*) FROM ev) book_records, (SELECT count(*) "
        "FROM ch) nbbo_records, (SELECT count(DISTINCT symbol) FROM ev) symbols"),
    "event_type_counts": tape_sql("", "SELECT venue, event_type, count(*) n, CAST(sum(qty) AS BIGINT) total_qty FROM ev GROUP BY ALL"),
    "store_stats": tape_sql("", f"SELECT {_STATS} FROM ev"),
    "ts_forward_fill": tape_sql("", "SELECT arrival, venue, coalesce(last_value(nullif(CASE WHEN arrival % 3 = 0 THEN 0 "
        "ELSE ns END, 0) IGNORE NULLS) OVER (PARTITION BY venue ORDER BY arrival ROWS UNBOUNDED PRECEDING), 0) exchange_ts_ns FROM ev"),
    "clock_rejects": tape_sql(_JIT, "SELECT venue, rejected, count(*) n, min(ns) min_ts, max(ns) max_ts "
        "FROM (SELECT *, ns < coalesce(max(ns) OVER (PARTITION BY venue ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) rejected "
            "FROM jit) GROUP BY ALL"),
    "first_wins_dedupe": tape_sql(_COPIES, "SELECT venue, seq AS sequence, feed, arrival, order_id FROM firsts"),
    "gap_report": tape_sql(_COPIES, "SELECT venue, gap_begin, gap_end, gap_end - gap_begin + 1 missing "
        "FROM (SELECT venue, coalesce(lag(seq) OVER (PARTITION BY venue ORDER BY seq), 0) + 1 gap_begin, seq - 1 gap_end FROM firsts) "
            "WHERE gap_end >= gap_begin"),
    "deterministic_merge": tape_sql(_JIT, "SELECT row_number() OVER (ORDER BY k, arrival) merge_rank, arrival, venue, seq AS sequence, ns exchange_ts_ns "
        "FROM (SELECT *, max({'ns': ns, 'venue': venue, 'seq': seq, 'raw': event_type}) OVER (PARTITION BY venue "
            "ORDER BY arrival ROWS UNBOUNDED PRECEDING) k FROM jit)"),
    "journal_diff": tape_sql(_DIFF, "SELECT venue, sequence, difference FROM df"),
    "stream_divergence": tape_sql(_DIFF, "SELECT count(*) FILTER (difference = 'changed') changed, count(*) FILTER (difference = 'left only') left_only, "
        "count(*) FILTER (difference = 'right only') right_only, count(*) total FROM df"),
    "book_levels": tape_sql("," + LEVELS_SQL, "SELECT arrival, venue, symbol, side, price, CAST(delta AS BIGINT) delta, depth FROM lv"),
    "queue_ahead": tape_sql("," + LEVELS_SQL, "SELECT arrival, order_id, CAST(depth - delta AS BIGINT) queue_ahead FROM lv WHERE event_type = 0"),
    "top_of_book": tape_sql("," + LEVELS_SQL, """SELECT venue, symbol, max(CASE WHEN side = 0 THEN price END) bid_price, arg_max(q, CASE
        WHEN side = 0 THEN price END) bid_qty, min(CASE WHEN side = 1 THEN price END) ask_price, arg_min(q, CASE WHEN side = 1 THEN price END) ask_qty
        FROM (SELECT venue, symbol, side, price, CAST(sum(delta) AS BIGINT) q FROM dl GROUP BY ALL) WHERE q > 0 GROUP BY ALL"""),
    "depth_snapshot": tape_sql("," + LEVELS_SQL, """SELECT venue, symbol, side, count(*) n_levels, string_agg(price || 'x' || q, ',' ORDER BY CASE
        WHEN side = 0 THEN -price ELSE price END) levels
        FROM (SELECT venue, symbol, side, price, CAST(sum(delta) AS BIGINT) q FROM dl GROUP BY ALL) WHERE q > 0 GROUP BY ALL"""),
    "book_reconcile": tape_sql("," + LEVELS_SQL + """,
        sums AS (SELECT venue, symbol, side, price, sum(delta) q FROM dl GROUP BY ALL HAVING sum(delta) > 0),
        alive AS (SELECT o.order_id, any_value(e.venue) venue, o.symbol, o.side, o.price, o.qty - coalesce(sum(CASE
        WHEN e.event_type IN (2, 4) THEN e.qty END), 0) rest
            FROM own o JOIN ev e USING (order_id) GROUP BY o.order_id, o.symbol, o.side, o.price, o.qty HAVING count(*) FILTER (e.event_type = 5) = 0),
        books AS (SELECT venue, symbol, side, price, sum(rest) q FROM alive WHERE rest > 0 GROUP BY ALL),
        both_ways AS (SELECT venue, a.q a, b.q b FROM sums a FULL JOIN books b USING (venue, symbol, side, price))""",
        "SELECT venue, count(a) n_levels, CAST(sum(a) AS BIGINT) depth, count(*) FILTER (a IS DISTINCT FROM b) differences FROM both_ways "
            "GROUP BY venue HAVING count(a) > 0"),
    "book_tops": tape_sql("," + TOPS_SQL, "SELECT arrival, venue, symbol, bid bid_price, bq bid_qty, ask ask_price, aq ask_qty, "
        "CAST(queue_ahead AS BIGINT) queue_ahead FROM tops"),
    "nbbo_consolidated": tape_sql("," + NBBO_SQL, f"SELECT arrival, symbol, {_BBO} FROM nb"),
    "nbbo_changes": tape_sql(_CHANGES, f"SELECT arrival, symbol, {_BBO} FROM ch"),
    "nbbo_journal": tape_sql("," + NBBO_SQL + """, moved AS (SELECT * FROM (SELECT *, row_number() OVER w first_row, lag({'a': bid, 'b': bq, 'c': ask,
        'd': aq}) OVER w was FROM tops WINDOW w AS (PARTITION BY venue, symbol ORDER BY arrival))
        WHERE CASE WHEN first_row = 1 THEN bid IS NOT NULL OR ask IS NOT NULL ELSE was IS DISTINCT FROM {'a': bid, 'b': bq, 'c': ask, 'd': aq} END),
        mv AS (SELECT nb.* FROM nb JOIN moved USING (arrival)), jr AS (SELECT *, row_number() OVER w first_row, lag({'a': bid_price, 'b': bid_qty,
        'c': bid_venue, 'd': ask_price, 'e': ask_qty, 'f': ask_venue}) OVER w was FROM mv WINDOW w AS (PARTITION BY symbol ORDER BY arrival))""",
        f"SELECT arrival, symbol, venue, {_BBO} FROM jr WHERE (first_row > 1 AND was IS DISTINCT FROM {{'a': bid_price, 'b': bid_qty, 'c': bid_venue, "
            f"'d': ask_price, 'e': ask_qty, 'f': ask_venue}}) OR (first_row = 1 AND (bid_price IS NOT NULL OR ask_price IS NOT NULL))"),
    "microprice": tape_sql("," + TWO_SQL, f"SELECT arrival, symbol, mid, {_MICRO} microprice FROM two"),
    "ofi_delta": tape_sql("," + OFI_SQL, "SELECT arrival, symbol, ofi_step ofi_delta FROM ofi1"),
    "ofi_window": tape_sql("," + OFI_SQL, "SELECT arrival, symbol, ofi FROM ofi2"),
    "ofi_events128": tape_sql(""", q AS (SELECT *, CASE WHEN side = 0 AND price > 0 THEN {'p': price, 'q': qty} END b, CASE WHEN side = 1
        AND price > 0 THEN {'p': price, 'q': qty} END a FROM ev),
        w AS (SELECT *, last_value(b IGNORE NULLS) OVER x pb, last_value(a IGNORE NULLS) OVER x pa FROM q WINDOW x AS (PARTITION BY symbol
        ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        st AS (SELECT *, CASE WHEN b IS NOT NULL THEN CASE WHEN pb IS NULL OR b.p > pb.p THEN b.q WHEN b.p = pb.p THEN b.q - pb.q ELSE -pb.q END
        WHEN a IS NOT NULL THEN CASE WHEN pa IS NULL OR a.p > pa.p THEN -a.q WHEN a.p = pa.p THEN pa.q - a.q ELSE pa.q END ELSE 0 END v FROM w)""",
        "SELECT arrival, symbol, CAST(sum(v) OVER (PARTITION BY symbol ORDER BY arrival ROWS BETWEEN 127 PRECEDING AND CURRENT ROW) AS BIGINT) ofi_events "
            "FROM st"),
    "effective_spread_ema": tape_sql("," + TWO_SQL + """, tr AS (SELECT *, CASE WHEN event_type IN (7, 8) THEN 2.0 * abs(price - mid) END s FROM two),
        ls AS (SELECT arrival, symbol, list(s) FILTER (s IS NOT NULL) OVER (PARTITION BY symbol ORDER BY arrival ROWS UNBOUNDED PRECEDING) l FROM tr)""",
        "SELECT arrival, symbol, round(coalesce(list_reduce(l, lambda x, y: 0.95 * x + (1 - 0.95) * y), 0.0), 6) effective_spread FROM ls"),
    "kyle_lambda": tape_sql("," + _KYLE, "SELECT arrival, symbol, kyle_lambda FROM kl"),
    "vpin": tape_sql("," + TWO_SQL + """, tr AS MATERIALIZED (SELECT symbol, arrival, side, qty, row_number() OVER (PARTITION BY symbol ORDER BY arrival) n
        FROM two WHERE event_type IN (7, 8)),
        st AS (SELECT symbol, CAST(0 AS BIGINT) n, CAST(0 AS BIGINT) buy, CAST(0 AS BIGINT) sell, CAST(NULL AS DOUBLE) tox, CAST(NULL AS BIGINT) arrival
        FROM (SELECT DISTINCT symbol FROM tr)
            UNION ALL SELECT symbol, n, CASE WHEN b + s < 200 THEN b WHEN b > b + s - 200 THEN b + s - 200 ELSE 0 END, CASE WHEN b + s < 200 THEN s
            WHEN s > CASE WHEN b > b + s - 200 THEN b + s - 200 ELSE 0 END THEN b + s - 200 - CASE WHEN b > b + s - 200 THEN b + s - 200 ELSE 0 END ELSE 0 END,
                CASE WHEN b + s >= 200 THEN abs(b - s) / 200.0 END, arrival
            FROM (SELECT t.symbol, t.n, t.arrival, st.buy + CASE WHEN t.side = 0 THEN t.qty ELSE 0 END b, st.sell + CASE WHEN t.side = 1 THEN t.qty
            ELSE 0 END s FROM st JOIN tr t ON t.symbol = st.symbol AND t.n = st.n + 1)),
        ls AS (SELECT arrival, symbol, list(tox) FILTER (tox IS NOT NULL) OVER (PARTITION BY symbol ORDER BY n ROWS UNBOUNDED PRECEDING) l FROM st)""",
        "SELECT arrival, symbol, round(coalesce(list_aggregate(list_slice(l, -32, -1), 'avg'), 0.0), 9) vpin FROM ls "
            "WHERE arrival IS NOT NULL").replace("WITH ", "WITH RECURSIVE ", 1),
    "feature_rows": tape_sql("," + OFI_SQL + _KYLE[len(TWO_SQL):], f"SELECT o.arrival, o.symbol, {_MICRO} microprice, CAST(o.ofi AS DOUBLE) ofi, "
        f"CAST(o.queue_ahead AS DOUBLE) queue_ahead, k.kyle_lambda, bid_price, ask_price FROM ofi2 o JOIN kl k USING (arrival)"),
}
