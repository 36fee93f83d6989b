"""Queries of queues, checked books and recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeloom.operators import nbbo, queues, sequence
from tapeloom.operators.book import NEEDED
from tapeloom.plans.market import LEVELS_SQL, TOPS_SQL, tape_sql
from tapeloom.shared import stored
from tapeloom.sources import files
from tapeloom.sources.adapter import TAPE_SQL, book_events

TICK = 16  # prices are cut to so many ticks, so that queues are long
EVERY = 1000
WINDOW = 4


def order_queue_position(spark, d):
    """Orders and lots before an order at each of its events."""
    ev = book_events(spark, d).withColumn("price", F.expr(f"price div {TICK} * {TICK}"))
    found = queues.queue_position(ev)
    return found.select("arrival", "venue", "symbol", "order_id", "side", "price", "remaining", "orders_ahead", "lots_ahead")


def reconcile_checkpoints(spark, d):
    """Books of a tape that lost every 97th message of a venue, checked every 1000 events against the whole tape."""
    # Numbering reads its rows three times and the checks read theirs six times.
    ev = stored(book_events(spark, d).select(*NEEDED, "sequence"), "checked-tape")
    points = stored(queues.numbered(ev, EVERY), "checked-points")
    return queues.checked(points, live=queues.snapshots(points.where("sequence % 97 <> 0")))


def _bursts(spark, d) -> DataFrame:
    """A tape that loses single messages and runs of ten, and on which some come late."""
    ev = book_events(spark, d).where("sequence % 53 <> 0 AND sequence % 70 NOT BETWEEN 20 AND 29")
    return ev.withColumn("arrival", F.col("arrival") + F.when(F.col("sequence") % 11 == 0, 60).otherwise(0))


def gap_requests(spark, d):
    """What each venue's tracker asks for, and why."""
    return sequence.requests(sequence.observed(_bursts(spark, d), WINDOW, compat=True))


def recovered_events(spark, d):
    """What the store of recent messages gives back to those requests."""
    return sequence.recovered(sequence.observed(_bursts(spark, d), WINDOW, compat=True), WINDOW)


def recovery_stats(spark, d):
    return sequence.tracker_stats(_bursts(spark, d), WINDOW, compat=True)


QUOTE = ["arrival", "venue", "symbol", "sequence", "exchange_ts_ns", "ingest_ts_ns"]


def nbbo_provenance(spark, d):
    """The quote journal with the messages that its sides come from."""
    return nbbo.provenance(book_events(spark, d), QUOTE).select("arrival", "symbol", *nbbo.BBO, *nbbo.SEQUENCES)


def nbbo_journal_stats(spark, d):
    """Events in, changes of a venue's top, quotes out, and the checksum of the journal's payloads."""
    ev = book_events(spark, d)
    tops = nbbo.with_tops(ev, keep=QUOTE)
    quotes = nbbo.provenance(ev, QUOTE)
    seen = tops.agg(F.count("*").alias("book_events_in"), F.count_if("changed_top").alias("top_changes"))
    crc = sequence.chained_crc(quotes, files.quote_payloads, files.FORMATS["nbbo"][1])
    return seen.join(F.broadcast(crc)).select("book_events_in", "top_changes", F.col("events").alias("nbbo_emitted"), F.col("crc").alias("journal_crc"))  # one row each


QUERIES = {f.__name__: f for f in (nbbo_provenance, nbbo_journal_stats, order_queue_position, reconcile_checkpoints, gap_requests, recovered_events, recovery_stats)}

_ALL = TAPE_SQL.replace("\nev AS (", "\nall_ev AS (")
_QUEUE = f"""WITH {_ALL},
ev AS (SELECT * REPLACE (price // {TICK} * {TICK} AS price) FROM all_ev),
{LEVELS_SQL.strip()},
left_ AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY order_id ORDER BY arrival) AS BIGINT) remaining FROM dl),
older AS (SELECT q.arrival, q.order_id, p.order_id other, sum(p.delta) lots FROM dl q JOIN dl p ON p.venue = q.venue AND p.symbol = q.symbol
        AND p.side = q.side AND p.price = q.price
    AND p.order_id < q.order_id AND p.arrival <= q.arrival GROUP BY ALL),
ahead AS (SELECT arrival, order_id, count(*) FILTER (lots > 0) orders_ahead, sum(lots) lots_ahead FROM older GROUP BY ALL)
SELECT arrival, venue, symbol, order_id, side, price, remaining, coalesce(orders_ahead, 0) orders_ahead, CAST(coalesce(lots_ahead, 0) AS BIGINT) lots_ahead
FROM left_ LEFT JOIN ahead USING (arrival, order_id)"""


def _levels_sql(name: str, source: str) -> str:
    """`<name>`: effects on levels of the events of `source`, with their checkpoint."""
    return f"""{name}_own AS (SELECT order_id, symbol, side, price, qty FROM {source} WHERE event_type = 0),
{name} AS (SELECT e.arrival, e.cp, e.venue, o.symbol, o.side, o.price,
    CASE e.event_type WHEN 0 THEN e.qty WHEN 5 THEN -(o.qty - coalesce(sum(CASE WHEN e.event_type IN (2,
        4) THEN e.qty END) OVER (PARTITION BY e.order_id ORDER BY e.arrival), 0)) ELSE -e.qty END delta
    FROM {source} e JOIN {name}_own o USING (order_id) WHERE e.event_type IN (0, 2, 4, 5))"""


_KEY = "venue, symbol, cp, side, price"
_RECONCILE = f"""WITH {TAPE_SQL},
pts AS (SELECT *, (row_number() OVER (ORDER BY arrival) + {EVERY - 1}) // {EVERY} cp FROM ev),
got AS (SELECT * FROM pts WHERE seq % 97 <> 0),
{_levels_sql('td', 'pts')},
{_levels_sql('ld', 'got')},
act AS (SELECT DISTINCT venue, symbol, cp, lead(cp) OVER (PARTITION BY venue, symbol ORDER BY cp) nxt FROM (SELECT DISTINCT venue, symbol, cp FROM pts)),
live_act AS (SELECT DISTINCT venue, symbol, cp FROM got),
truth AS (SELECT a.venue, a.symbol, a.cp, d.side, d.price, sum(d.delta) q FROM act a JOIN td d ON d.venue = a.venue AND d.symbol = a.symbol
        AND d.cp <= a.cp GROUP BY ALL HAVING sum(d.delta) <> 0),
live AS (SELECT a.venue, a.symbol, a.cp, d.side, d.price, sum(d.delta) q FROM live_act a JOIN ld d ON d.venue = a.venue AND d.symbol = a.symbol
        AND d.cp <= a.cp GROUP BY ALL HAVING sum(d.delta) <> 0),
replay AS (SELECT {_KEY}, sum(q) q FROM (SELECT l.venue, l.symbol, a.nxt cp, l.side, l.price, l.q FROM live l JOIN act a USING (venue, symbol, cp)
        WHERE a.nxt IS NOT NULL
    UNION ALL SELECT {_KEY}, delta FROM td) GROUP BY ALL HAVING sum(q) <> 0),
a1 AS (SELECT cp, count(l.q) levels, count(*) FILTER (l.q IS DISTINCT FROM t.q) differences FROM live l FULL JOIN truth t USING ({_KEY}) GROUP BY cp),
a2 AS (SELECT cp, count(*) FILTER (l.q IS DISTINCT FROM r.q) new_differences FROM live l FULL JOIN replay r USING ({_KEY}) GROUP BY cp)
SELECT cp checkpoint, count(*) AS events, count(DISTINCT (venue, symbol)) books, any_value(levels) levels, any_value(differences) differences,
        any_value(new_differences) new_differences
FROM pts LEFT JOIN a1 USING (cp) LEFT JOIN a2 USING (cp) GROUP BY cp"""

#: `tk`: the tracker in compat mode. A number that was jumped over is the next one expected; the first request after it gives it back from the store.
_FIRST_FREE = "list_min(list_filter(range(was + 1, was + len(kept) + 2), lambda s: NOT list_contains(kept, s)))"
_COMPAT = f"""WITH RECURSIVE {TAPE_SQL},
bursts AS (SELECT venue, seq, arrival + CASE WHEN seq % 11 = 0 THEN 60 ELSE 0 END arrival FROM ev WHERE seq % 53 <> 0 AND seq % 70 NOT BETWEEN 20 AND 29),
arr AS MATERIALIZED (SELECT venue, arrival, seq, row_number() OVER (PARTITION BY venue ORDER BY arrival, seq) n FROM bursts),
tk AS (SELECT venue, CAST(0 AS BIGINT) n, CAST(NULL AS BIGINT) arrival, CAST(NULL AS BIGINT) seq, CAST(NULL AS VARCHAR) status, CAST(NULL AS BIGINT) wanted,
        CAST(1 AS BIGINT) was, CAST(1 AS BIGINT) nxt,
    CAST([] AS BIGINT[]) held, FALSE jumped, FALSE again, CAST(0 AS BIGINT) evicted FROM (SELECT DISTINCT venue FROM arr)
  UNION ALL
  SELECT venue, n, arrival, seq, status, wanted, was, nxt, list_filter(kept, lambda s: s >= nxt), CASE WHEN status = 'gap_too_large' THEN TRUE
      WHEN nxt > was THEN FALSE ELSE jumped END, again, evicted FROM (
    SELECT *, CASE WHEN status = 'in_order' OR again THEN {_FIRST_FREE} ELSE was END nxt FROM (
      SELECT venue, n, arrival, seq, status, nxt wanted, jumped, status = 'gap_buffered' AND jumped again, CASE WHEN status = 'gap_too_large' THEN seq
          ELSE nxt END was,
        CASE status WHEN 'gap_buffered' THEN list_append(held, seq) WHEN 'gap_too_large' THEN list_filter(held, lambda s: s >= seq) ELSE held END kept,
        CASE WHEN status = 'gap_too_large' THEN len(list_filter(held, lambda s: s < seq)) ELSE 0 END evicted
      FROM (SELECT a.venue, a.n, a.arrival, a.seq, t.nxt, t.held, t.jumped, CASE WHEN a.seq = 0 OR a.seq < t.nxt OR list_contains(t.held, a.seq)
          AND a.seq - t.nxt <= {WINDOW} THEN 'duplicate'
          WHEN a.seq = t.nxt THEN 'in_order' WHEN a.seq - t.nxt <= {WINDOW} THEN 'gap_buffered' ELSE 'gap_too_large' END status
        FROM tk t JOIN arr a ON a.venue = t.venue AND a.n = t.n + 1)))),
looked AS (SELECT * FROM tk WHERE n > 0)"""

_V = range(5)
_TOP = "{'bid': bid, 'bq': bq, 'ask': ask, 'aq': aq}"
_TEN = "{'a': bid_price, 'b': bid_qty, 'c': bid_venue, 'd': bid_venue_sequence, 'e': ask_price, 'f': ask_qty, 'g': ask_venue, 'h': ask_venue_sequence}"
_PROVENANCE = TOPS_SQL + f""",
moved AS (SELECT * FROM (SELECT *, row_number() OVER w nth, lag({_TOP}) OVER w was FROM tops WINDOW w AS (PARTITION BY venue, symbol ORDER BY arrival))
    WHERE CASE WHEN nth = 1 THEN bid IS NOT NULL OR ask IS NOT NULL ELSE was IS DISTINCT FROM {_TOP} END),
vs AS (SELECT *, {", ".join(f"last_value(CASE WHEN venue = {v} THEN {{'bid': bid, 'bq': bq, 'ask': ask, 'aq': aq, 'seq': seq}} END IGNORE NULLS) OVER w v{v}" for v in _V)} FROM moved
    WINDOW w AS (PARTITION BY symbol ORDER BY arrival ROWS UNBOUNDED PRECEDING)),
ks AS (SELECT *, list_max([{", ".join(f"v{v}.bid * 8 + {7 - v}" for v in _V)}]) bk, list_min([{", ".join(f"v{v}.ask * 8 + {v}" for v in _V)}]) ak FROM vs),
qs AS (SELECT arrival, symbol, ns, bk // 8 bid_price, 7 - bk % 8 bid_venue, {", "
    "".join(f"CASE 7 - bk % 8 {' '.join(f'WHEN {v} THEN v{v}.{f}' for v in _V)} END {n}" for f, n in (("bq", "bid_qty"), ("seq", "bid_venue_sequence")))},
    ak // 8 ask_price, ak % 8 ask_venue, {", ".join(f"CASE ak % 8 {' '.join(f'WHEN {v} THEN v{v}.{f}' for v in _V)} END {n}" for f, n in (("aq", "ask_qty"), ("seq", "ask_venue_sequence")))} FROM ks),
jr AS (SELECT * FROM (SELECT *, row_number() OVER w nth, lag({_TEN}) OVER w was FROM qs WINDOW w AS (PARTITION BY symbol ORDER BY arrival))
    WHERE CASE WHEN nth = 1 THEN bid_price IS NOT NULL OR ask_price IS NOT NULL ELSE was IS DISTINCT FROM {_TEN} END)"""


def _octets(x: str, n: int) -> str:
    return f"list_transform(range({n}), lambda i: (CAST(coalesce({x}, 0) AS BIGINT) >> (8 * i)) & 255)"


_QUOTE_OCTETS = " || ".join(
    ["list_reverse(list_transform(range(8), lambda i: CAST(ascii(substr(rpad(symbol, 8, ' '), CAST(i + 1 AS BIGINT), "
        "1)) AS BIGINT)))", _octets("ns", 8), _octets("ns", 8)]
    + [_octets("CASE WHEN bid_price IS NULL THEN 0 ELSE 1 END", 1), _octets("CASE WHEN ask_price IS NULL THEN 0 ELSE 1 END", 3)]
    + [_octets(c, 4) for c in ("bid_price", "bid_qty", "ask_price", "ask_qty")]
    + [_octets("bid_venue", 1), _octets("ask_venue", 3), _octets("bid_venue_sequence", 8), _octets("ask_venue_sequence", 8)]
)
_CRC_STEP = "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])"

ORACLE_SQL = {
    "nbbo_provenance": tape_sql("," + _PROVENANCE, "SELECT arrival, symbol, bid_price, bid_qty, bid_venue, ask_price, ask_qty, ask_venue, bid_venue_sequence, "
        "ask_venue_sequence FROM jr"),
    "nbbo_journal_stats": tape_sql("," + _PROVENANCE + """,
        tb AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE
        WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) t)""", f"""
        SELECT (SELECT count(*) FROM ev) book_events_in, (SELECT count(*) FROM moved) top_changes, n nbbo_emitted,
        xor(list_reduce(list_prepend(4294967295::BIGINT, octets), {_CRC_STEP}), 4294967295) journal_crc
        FROM (SELECT count(*) n, flatten(list(CAST({_QUOTE_OCTETS} AS BIGINT[]) ORDER BY arrival)) octets FROM jr), tb"""),
    "order_queue_position": _QUEUE,
    "reconcile_checkpoints": _RECONCILE,
    "gap_requests": f"""{_COMPAT}
SELECT venue, arrival, wanted gap_begin, seq - 1 gap_end, seq - wanted missing, CASE status WHEN 'gap_buffered' THEN 'gap_detected' ELSE status END reason
        FROM looked WHERE status IN ('gap_buffered', 'gap_too_large')""",
    "recovered_events": f"""{_COMPAT}
SELECT r.venue, r.arrival requested_at, s.seq AS sequence, max(s.arrival) stored_at, arg_max(s.status, s.n) = 'gap_too_large' reinjected
FROM looked r JOIN looked s ON s.venue = r.venue AND s.n < r.n AND s.seq BETWEEN r.wanted AND r.seq - 1 WHERE r.status = 'gap_buffered' GROUP BY ALL""",
    "recovery_stats": f"""{_COMPAT}
SELECT venue, CAST(sum(CASE WHEN status = 'in_order' OR again THEN nxt - was ELSE 0 END) AS BIGINT) accepted, count(*) FILTER (status = 'duplicate') duplicate,
        count(*) FILTER (status = 'gap_buffered') buffered,
    count(*) FILTER (status = 'gap_too_large') too_large, CAST(sum(evicted) AS BIGINT) evicted, count(*) FILTER (status IN ('gap_buffered',
        'gap_too_large')) requests, count(*) FILTER (again) reinjected FROM looked GROUP BY venue""",
}
