"""SQL of what is sequential: trackers and market making as recursions, a row an event and key."""

from __future__ import annotations

from tapeloom.plans.market import HOUR, TWO_SQL
from tapeloom.sources.adapter import TAPE_SQL


def _recursive(parts: str, select: str, tape: str = TAPE_SQL) -> str:
    return f"WITH RECURSIVE {tape}{parts}\n{select}"


# -- trackers -------------------------------------------------------------------------------------------------------
def _tracked(rows: str, window: int = 64) -> str:
    """`tk`: each arrival with its status, and the range of sequence numbers that it releases, `was` to `nxt` - 1.

    A number inside a gap was never seen before (else it would be held), so nothing is given back from memory.
    """
    return f""",
arr AS MATERIALIZED (SELECT venue, arrival, seq, row_number() OVER (PARTITION BY venue ORDER BY arrival, seq) n FROM {rows}),
tk AS (SELECT venue, CAST(0 AS BIGINT) n, CAST(NULL AS BIGINT) arrival, CAST(NULL AS BIGINT) seq, CAST(NULL AS VARCHAR) status, CAST(1 AS BIGINT) was,
        CAST(1 AS BIGINT) nxt, CAST([] AS BIGINT[]) held, CAST(0 AS BIGINT) evicted FROM (SELECT DISTINCT venue FROM arr)
  UNION ALL
  SELECT venue, n, arrival, seq, status, was, nxt, list_filter(kept, lambda s: s >= nxt), evicted FROM (
    SELECT *, CASE WHEN status IN ('in_order', 'gap_too_large') THEN list_min(list_filter(range(was + 1, was + len(kept) + 2),
        lambda s: NOT list_contains(kept, s))) ELSE was END nxt FROM (
      SELECT venue, n, arrival, seq, status, CASE WHEN status = 'gap_too_large' THEN seq ELSE nxt END was,
        CASE status WHEN 'gap_buffered' THEN list_append(held, seq) WHEN 'gap_too_large' THEN list_filter(held, lambda s: s >= seq) ELSE held END kept,
        CASE WHEN status = 'gap_too_large' THEN len(list_filter(held, lambda s: s < seq)) ELSE 0 END evicted
      FROM (SELECT a.venue, a.n, a.arrival, a.seq, t.nxt, t.held, CASE WHEN a.seq = 0 OR a.seq < t.nxt OR list_contains(t.held, a.seq)
          AND a.seq - t.nxt <= {window} THEN 'duplicate' WHEN a.seq = t.nxt THEN 'in_order'
          WHEN a.seq - t.nxt <= {window} THEN 'gap_buffered' ELSE 'gap_too_large' END status
        FROM tk t JOIN arr a ON a.venue = t.venue AND a.n = t.n + 1))))"""


_LOSSY = ", lossy AS (SELECT venue, seq, arrival + CASE WHEN seq % 11 = 0 THEN 200 ELSE 0 END arrival FROM ev WHERE seq % 53 <> 0)"
_COPIES = ", copies AS (SELECT venue, seq, arrival * 2 arrival FROM ev WHERE seq % 7 <> 0 UNION ALL SELECT venue, seq, arrival * 2 + 1 FROM ev WHERE seq % 5 <> 0)"

# -- market making --------------------------------------------------------------------------------------------------
ON_TIME_SQL = TAPE_SQL.replace("\nev AS (", "\nall_ev AS (") + """,
ev AS (SELECT * EXCLUDE (late) FROM (SELECT *, ns < coalesce(max(ns) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) late
        FROM all_ev) WHERE NOT late)"""

#: `sim`: market making with 20 lots at two ticks around the microprice, at most half of a print filled: a side has one live order at most.
SIM_SQL = "," + TWO_SQL.lstrip() + """,
pr AS MATERIALIZED (SELECT nb.symbol, nb.arrival, nb.ns, nb.event_type, nb.side, nb.price, nb.qty // 2 budget, t.bid_price, t.ask_price,
        last_value(t.mid IGNORE NULLS) OVER (PARTITION BY nb.symbol ORDER BY nb.arrival ROWS UNBOUNDED PRECEDING) mid,
    CASE WHEN t.mid IS NOT NULL THEN CAST(floor(0.5 + CASE WHEN t.bid_qty + t.ask_qty > 0 THEN CAST(t.ask_price * t.bid_qty + t.bid_price * t.ask_qty AS DOUBLE) / (t.bid_qty + t.ask_qty) ELSE t.mid END) AS BIGINT) END fair,
    row_number() OVER (PARTITION BY nb.symbol ORDER BY nb.arrival) n
    FROM nb LEFT JOIN two t ON t.arrival = nb.arrival AND t.bid_price <> 0 AND t.ask_price <> 0),
sim AS (SELECT symbol, CAST(0 AS BIGINT) n, CAST(NULL AS BIGINT) arrival, CAST(NULL AS BIGINT) ns, CAST(NULL AS DOUBLE) mid, CAST(0 AS BIGINT) sent,
        CAST(0 AS BIGINT) cancelled, CAST(NULL AS BIGINT) center, CAST(0 AS BIGINT) last_ts,
    CAST(0 AS BIGINT) b_no, CAST(0 AS BIGINT) b_px, CAST(0 AS BIGINT) b_left, FALSE b_taker, CAST(0 AS BIGINT) a_no, CAST(0 AS BIGINT) a_px,
        CAST(0 AS BIGINT) a_left, FALSE a_taker,
    CAST(0 AS BIGINT) f_no, CAST(0 AS BIGINT) f_side, CAST(0 AS BIGINT) f_price, CAST(0 AS BIGINT) f_qty, FALSE f_partial, FALSE f_taker,
        CAST(0 AS BIGINT) position, CAST(0 AS DOUBLE) cash, CAST(0 AS DOUBLE) cost, CAST(0 AS DOUBLE) realized, CAST(0 AS DOUBLE) gain
        FROM (SELECT DISTINCT symbol FROM pr)
  UNION ALL
  SELECT symbol, n, arrival, ns, mid, sent, cancelled, CASE WHEN take > 0 THEN NULL ELSE center END, last_ts,
    b_no, b_px, CASE WHEN f_side = 0 THEN b_left - take ELSE b_left END, b_taker, a_no, a_px, CASE WHEN f_side = 1 THEN a_left - take ELSE a_left END, a_taker,
    CASE f_side WHEN 0 THEN b_no WHEN 1 THEN a_no END, f_side, price, take, take < CASE f_side WHEN 0 THEN b_left ELSE a_left END, CASE f_side
        WHEN 0 THEN b_taker ELSE a_taker END, CAST(position + signed AS BIGINT), cash - CAST(price AS DOUBLE) * signed,
    CASE WHEN take = 0 THEN cost WHEN position * signed >= 0 THEN (cost * abs(position) + CAST(price AS DOUBLE) * take) / (abs(position) + take)
        WHEN position + signed = 0 THEN 0.0 WHEN (position + signed > 0) <> (position > 0) THEN price ELSE cost END,
    realized + gain, gain
  FROM (SELECT *, CASE WHEN position * signed < 0 THEN (price - cost) * least(abs(position), take) * sign(position) ELSE 0.0 END gain FROM (
    SELECT *, CASE f_side WHEN 0 THEN take ELSE -take END signed FROM (
    SELECT *, CASE f_side WHEN 0 THEN least(b_left, budget) WHEN 1 THEN least(a_left, budget) ELSE 0 END take FROM (
    SELECT *, CASE WHEN event_type NOT IN (3, 7, 8) OR budget <= 0 THEN NULL WHEN side = 1 AND b_left > 0 AND b_px >= price THEN 0 WHEN side = 0
        AND a_left > 0 AND a_px <= price THEN 1 END f_side FROM (
    SELECT symbol, n, arrival, ns, mid, event_type, side, price, budget, position, cash, cost, realized,
        CASE WHEN go THEN sent + 2 ELSE sent END sent, CASE WHEN go THEN cancelled + CAST(b_left > 0 AS BIGINT) + CAST(a_left > 0 AS BIGINT)
        ELSE cancelled END cancelled,
        CASE WHEN go THEN fair ELSE center END center, CASE WHEN go THEN ns ELSE last_ts END last_ts,
        CASE WHEN go THEN sent + 1 ELSE b_no END b_no, CASE WHEN go THEN fair - 2 ELSE b_px END b_px, CASE WHEN go THEN 20 ELSE b_left END b_left, CASE
        WHEN go THEN fair - 2 >= ask_price ELSE b_taker END b_taker,
        CASE WHEN go THEN sent + 2 ELSE a_no END a_no, CASE WHEN go THEN fair + 2 ELSE a_px END a_px, CASE WHEN go THEN 20 ELSE a_left END a_left, CASE
        WHEN go THEN fair + 2 <= bid_price ELSE a_taker END a_taker
    FROM (SELECT s.* EXCLUDE (n, arrival, ns, mid), p.n, p.arrival, p.ns, p.mid, p.event_type, p.side, p.price, p.budget, p.bid_price, p.ask_price, p.fair,
            p.fair IS NOT NULL AND (s.center IS NULL OR p.fair <> s.center) AND p.ns >= s.last_ts go
        FROM sim s JOIN pr p ON p.symbol = s.symbol AND p.n = s.n + 1)))))))"""

EQUITY_SQL = SIM_SQL + f""",
eq AS (SELECT symbol, n, arrival, ns, sent, cancelled, position, cash, realized, f_qty, f_side, gain, cash + position * coalesce(mid, cost) equity
        FROM sim WHERE n > 0),
curve AS (SELECT arrival, ns, sum(change) OVER (ORDER BY arrival ROWS UNBOUNDED PRECEDING) equity FROM (SELECT arrival, ns, equity - lag(equity, 1,
        0.0) OVER (PARTITION BY symbol ORDER BY arrival) change FROM eq)),
bk AS (SELECT bucket, equity, equity - lag(equity) OVER (ORDER BY bucket) r FROM (SELECT ns // {24 * HOUR} bucket, arg_min(equity, arrival) equity
        FROM curve GROUP BY 1)),
fall AS (SELECT max(peak - equity) fall FROM (SELECT equity, max(equity) OVER (ORDER BY arrival ROWS UNBOUNDED PRECEDING) peak FROM curve))"""

_SHARPE = "coalesce(CASE WHEN count(r) >= 2 AND var_pop(r) > 0 THEN avg(r) / sqrt(var_pop(r)) END, 0.0)"

ORACLE_SQL = {
    "sequence_release": _recursive(_LOSSY + _tracked("lossy") + """,
        rel AS (SELECT venue, s seq, row_number() OVER (PARTITION BY venue ORDER BY n, s) AS release FROM (SELECT venue, n, unnest(range(was, nxt)) s
        FROM tk WHERE status IN ('in_order', 'gap_too_large')))""",
        "SELECT t.venue, t.arrival, t.seq AS sequence, t.status, r.release FROM tk t LEFT JOIN rel r ON r.venue = t.venue AND r.seq = t.seq "
            "AND t.status <> 'duplicate' WHERE t.n > 0"),
    "sequence_stats": _recursive(_COPIES + _tracked("copies"), """SELECT venue, CAST(coalesce(sum(nxt - was) FILTER (status IN ('in_order', 'gap_too_large')),
        0) AS BIGINT) accepted, count(*) FILTER (status = 'duplicate') duplicate, count(*) FILTER (status = 'gap_buffered') buffered,
        count(*) FILTER (status = 'gap_too_large') too_large, CAST(sum(evicted) AS BIGINT) evicted, count(*) FILTER (status IN ('gap_buffered',
        'gap_too_large')) requests, CAST(0 AS BIGINT) reinjected FROM tk WHERE n > 0 GROUP BY venue"""),
    "sim_fills_mm": _recursive(SIM_SQL, "SELECT symbol, arrival, f_no number, f_side side, f_price price, f_qty qty, f_partial partial, f_taker taker, "
        "round(gain, 6) realized FROM sim WHERE f_qty > 0", ON_TIME_SQL),
    "intents_mm": _recursive(SIM_SQL + ", fin AS (SELECT symbol, max(sent) sent, max(cancelled) cancelled FROM sim "
        "GROUP BY symbol)", "SELECT symbol, 'submit' AS action, sent n, sent * 20 qty FROM fin WHERE sent > 0 UNION ALL "
            "SELECT symbol, 'cancel', cancelled, 0 FROM fin WHERE cancelled > 0", ON_TIME_SQL),
    "pnl_by_symbol": _recursive(EQUITY_SQL, "SELECT symbol, arg_max(sent, n) submitted, arg_max(position, n) AS position, round(arg_max(cash, n), 4) cash, "
        "round(arg_max(realized, n), 4) realized, round(arg_max(equity, n), 4) equity, count(*) FILTER (f_qty > 0) fills FROM eq GROUP BY symbol", ON_TIME_SQL),
    "equity_buckets": _recursive(EQUITY_SQL, "SELECT bucket, round(equity, 4) equity, round(r, 4) r FROM bk", ON_TIME_SQL),
    "experiment_report": _recursive(EQUITY_SQL, f"""SELECT submitted, cancelled, fills, round(realized, 6) realized, round(unrealized, 6) unrealized,
        round(turnover, 6) turnover, round(fees, 6) fees, round(rebates, 6) rebates, round(equity - fees + rebates, 6) equity,
        round(CASE WHEN submitted > 0 THEN fills / submitted ELSE 0.0 END, 6) fill_ratio, round(fall, 6) max_drawdown, round(sharpe, 6) sharpe FROM
        (SELECT CAST(sum(sent) AS BIGINT) submitted, CAST(sum(cancelled) AS BIGINT) cancelled, sum(realized) realized, sum(unrealized) unrealized,
        sum(equity) equity FROM
            (SELECT arg_max(sent, n) sent, arg_max(cancelled, n) cancelled, arg_max(realized, n) realized, coalesce(arg_max((mid - cost) * position, n),
            0.0) unrealized, arg_max(cash + position * coalesce(mid, cost), n) equity FROM sim WHERE n > 0 GROUP BY symbol)),
        (SELECT count(*) fills, coalesce(sum(CAST(f_price AS DOUBLE) * f_qty), 0.0) turnover, coalesce(sum(CASE
        WHEN f_taker THEN 0.003 * f_qty END), 0.0) fees, coalesce(sum(CASE WHEN NOT f_taker THEN 0.002 * f_qty END), 0.0) rebates FROM sim WHERE f_qty > 0),
        (SELECT max(greatest(peak, 0.0) - equity) fall FROM (SELECT equity, max(equity) OVER (ORDER BY arrival ROWS UNBOUNDED PRECEDING) peak
        FROM curve)), (SELECT {_SHARPE} sharpe FROM bk)""", ON_TIME_SQL),
    "risk_metrics": _recursive(EQUITY_SQL, f"""SELECT round(sharpe, 9) sharpe, round(sortino, 9) sortino, n_returns, round(fall, 6) max_drawdown,
        round(win_rate, 9) win_rate, round(avg_trade, 6) avg_trade, n_trades FROM
        (SELECT {_SHARPE} sharpe, coalesce(avg(r) / nullif(sqrt(avg(CASE WHEN r < 0 THEN r * r END)), 0), 0.0) sortino, count(r) n_returns FROM bk), fall,
        (SELECT coalesce(avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END), 0.0) win_rate, coalesce(avg(gain), 0.0) avg_trade, count(*) n_trades FROM eq
        WHERE f_qty > 0 AND gain <> 0)""", ON_TIME_SQL),
}
