"""Queries of labels, signals, folds, evaluation and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import stats
from tapeloom.operators import features, nbbo, research
from tapeloom.plans.market import _KYLE, HOUR, OFI_SQL, ORACLE_SQL as MARKET_SQL, QUOTED, TWO_SQL, VPIN_VOLUME, WINDOW, tape_sql
from tapeloom.shared import stored
from tapeloom.sources.adapter import book_events

HORIZONS = (HOUR, 6 * HOUR, 24 * HOUR)
PURGE, EMBARGO = 2 * HOUR, HOUR
#: All signals of the zoo.
SIGNALS = (
    "ofi", "microprice_minus_mid", "queue_ahead", "effective_spread", "kyle_lambda", "vpin", "ofi_zscore", "microprice_spread_adj", "ofi_times_spread", "sign_microprice_minus_mid",
    "neg_effective_spread", "queue_over_spread", "bid_ask_imbalance",
)


def _rows(spark, d):
    """Feature rows with mid, without the sequential features, which their own queries cover. Stored, as folds, labels and signals all read them."""
    q = features.two_sided(nbbo.nbbo(book_events(spark, d), keep=QUOTED)).withColumn("ofi_step", features.ofi_delta())
    q = q.withColumn("ofi", features.trailing_sum("ofi_step", WINDOW).cast("double")).withColumn("microprice", features.microprice())
    return stored(research.with_mid(features.with_kyle(q).withColumn("queue_ahead", F.col("queue_ahead").cast("double"))), "research-rows")


def _scored(rows):
    """With z-scores, in digits that do not hang on the order of a sum, as evaluation ranks them."""
    return research.with_zscore(rows, block=4096).withColumn("ofi_zscore", F.round("ofi_zscore", 9))


def _pairs(spark, d):
    """Every signal's values with labels and folds; the sequential features in digits that do not hang on how they are averaged."""
    rows = _rows(spark, d)
    walked = features.with_recursions(rows, VPIN_VOLUME)
    # Stored, as signals, labels and folds each read them, ranks more than once, and a walk is never run for one of them only.
    rows = stored(walked.withColumn("effective_spread", F.round("effective_spread", 9)).withColumn("vpin", F.round("vpin", 9)), "research-walked")
    return research.evaluation_rows(research.SignalRegistry().wide(_scored(rows), SIGNALS), research.forward_labels(rows, HORIZONS), research.test_folds(rows), SIGNALS)


def forward_labels(spark, d):
    return research.forward_labels(_rows(spark, d), HORIZONS).select("arrival", "horizon", F.round("label", 10).alias("label"))


def labelled_features(spark, d):
    r = research.labelled_features(_rows(spark, d), HORIZONS)
    return r.select("arrival", "symbol", "mid", *(F.round(F.col("labels")[k], 10).alias(f"label_{k}") for k in range(len(HORIZONS))))


def signal_zoo(spark, d):
    """All thirteen signals of every row."""
    q = features.two_sided(nbbo.nbbo(book_events(spark, d), keep=QUOTED)).withColumn("ofi_step", features.ofi_delta())
    q = q.withColumn("ofi", features.trailing_sum("ofi_step", WINDOW).cast("double")).withColumn("microprice", features.microprice())
    rows = research.with_mid(features.with_kyle(features.with_recursions(q, VPIN_VOLUME)).withColumn("queue_ahead", F.col("queue_ahead").cast("double")))
    return research.SignalRegistry().long(_scored(rows)).select("arrival", "signal", F.round("value", 9).alias("value"))


def ofi_zscore(spark, d):
    return research.with_zscore(_rows(spark, d), block=4096).select("arrival", F.round("ofi_zscore", 6).alias("ofi_zscore"))


def ofi_zscore_by_symbol(spark, d):
    return research.with_zscore(_rows(spark, d), by_symbol=True).select("arrival", F.round("ofi_zscore", 6).alias("ofi_zscore"))


def purged_folds(spark, d):
    a = research.purged_folds(_rows(spark, d), purge=PURGE, embargo=EMBARGO)
    return a.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("exchange_ts_ns").alias("lo"), F.max("exchange_ts_ns").alias("hi"), F.sum("arrival").alias("arrivals"))


def leak_check(spark, d):
    return research.leaks(research.purged_folds(_rows(spark, d), purge=PURGE, embargo=EMBARGO), 6 * HOUR)


def signal_fold_metrics(spark, d):
    m = research.fold_metrics(_pairs(spark, d))
    return m.select("signal", "horizon", "fold", F.round("ic", 6).alias("ic"), F.round("hit_rate", 6).alias("hit_rate"), F.round("quintile_spread", 8).alias("quintile_spread"), "n")


def signal_aggregate(spark, d):
    a = research.aggregate_metrics(research.fold_metrics(_pairs(spark, d)))
    return a.select("signal", "horizon", F.round("mean_ic", 6).alias("mean_ic"), F.round("std_ic", 6).alias("std_ic"), F.round("mean_spread", 8).alias("mean_spread"), F.round("std_spread", 8).alias("std_spread"), "folds")


def top_signals(spark, d):
    t = research.top_signals(research.aggregate_metrics(research.fold_metrics(_pairs(spark, d))), 10)
    return t.select("signal", "horizon", F.round("mean_ic", 6).alias("mean_ic"))


def sharpe_moments(spark, d):
    r = F.signum("value") * F.col("label")
    g = _pairs(spark, d).groupBy("signal", "horizon").agg(stats.sharpe(r).alias("sharpe"), stats.skewness(r).alias("skew"), stats.excess_kurtosis(r).alias("kurtosis"), F.count("*").alias("n"))
    return g.select("signal", "horizon", *(F.round(c, 5).alias(c) for c in ("sharpe", "skew", "kurtosis")), "n")


def deflated_sharpe(spark, d):
    """Of the signal with the best ratio at the first horizon, for as many trials as there are signals, horizons and folds."""
    r = F.signum("value") * F.col("label")
    g = _pairs(spark, d).groupBy("signal", "horizon").agg(stats.sharpe(r).alias("sr"), stats.skewness(r).alias("skew"), stats.excess_kurtosis(r).alias("kurt"), F.count("*").alias("n")).orderBy("signal", "horizon").collect()
    best = max((x for x in g), key=lambda x: (round(x["sr"], 9), x["signal"]))
    mean = sum(x["sr"] for x in g) / len(g)
    std = (sum((x["sr"] - mean) ** 2 for x in g) / len(g)) ** 0.5
    out = stats.deflated_sharpe(best["sr"], best["skew"], best["kurt"] + 3, best["n"], len(g) * research.FOLDS, std)
    return spark.createDataFrame([(best["signal"], best["horizon"], *(round(out[k], 6) for k in ("adjusted", "expected_max", "z", "p_value")))], "signal string, horizon long, adjusted double, expected_max double, z double, p_value double")


def pbo(spark, d):
    """Fold scores against those of the fold after it."""
    m = research.fold_metrics(_pairs(spark, d)).where(F.col("horizon") == HORIZONS[0])
    after = m.select("signal", (F.col("fold") - 1).alias("fold"), F.col("ic").alias("oos_score"))
    s = stats.overfit_probability(m.select("signal", "fold", F.col("ic").alias("is_score")).join(after, ["signal", "fold"]))
    return s.select(F.round("pbo", 6).alias("pbo"), "comparisons")


def _costed(spark, d):
    rows = _rows(spark, d)
    labels = research.forward_labels(rows, HORIZONS[:1])
    pairs = rows.select("arrival", F.col("ofi").alias("value"), research.spread().alias("spread")).join(labels, "arrival").where("label IS NOT NULL")
    return pairs.withColumn("spread", F.col("spread") * 1e-4)


def capacity_sweep(spark, d):
    c = research.capacity_sweep(_costed(spark, d))
    return c.select("participation", F.round("gross_sharpe", 6).alias("gross_sharpe"), F.round("net_sharpe", 6).alias("net_sharpe"), F.round("mean_return", 10).alias("mean_return"))


def capacity_ceiling(spark, d):
    return research.capacity_ceiling(research.capacity_sweep(_costed(spark, d)))


def calibrated_impact(spark, d):
    return research.calibrated_impact(_rows(spark, d).select(research.spread().alias("spread"))).select(F.round("impact_lambda", 12).alias("impact_lambda"))


def proxy_sharpe(spark, d):
    p = research.proxy_sharpe(_pairs(spark, d).where(F.col("horizon") == HORIZONS[0]))
    return p.select("signal", "fold", F.round("sharpe", 6).alias("sharpe"), F.col("fills").cast("long").alias("fills"))


def ablation(spark, d):
    pairs = _pairs(spark, d).where(F.col("horizon") == HORIZONS[0])
    spreads = _rows(spark, d).select("arrival", research.spread().alias("spread"))
    a = research.ablation_report(pairs, "ofi", spreads, stats.sharpe(F.signum("value") * F.col("label")))
    return a.select("variant", F.round("mean_ic", 6).alias("mean_ic"), F.round("mean_spread", 8).alias("mean_spread"), F.round("net_sharpe", 6).alias("net_sharpe"))


def latency_histogram(spark, d):
    gap = _gaps(spark, d)
    return stats.histogram(gap, "gap", 1).select("bucket", "n", "low")


def _gaps(spark, d):
    from pyspark.sql.window import Window

    gap = F.col("exchange_ts_ns") - F.lag("exchange_ts_ns").over(Window.partitionBy("symbol").orderBy("arrival"))
    return book_events(spark, d).select((gap / 1000).cast("long").alias("gap")).where("gap > 0")


def histogram_quantiles(spark, d):
    h = stats.histogram(_gaps(spark, d), "gap", 1)
    out = stats.histogram_quantile(h, 0.5).select(F.lit(0.5).alias("p"), "quantile")
    for p in (0.9, 0.99):
        out = out.union(stats.histogram_quantile(h, p).select(F.lit(p).alias("p"), "quantile"))
    return out


def nearest_rank(spark, d):
    gaps = _gaps(spark, d)
    out = stats.nearest_rank(gaps, "gap", 0.5).select(F.lit(0.5).alias("p"), "value")
    for p in (0.9, 0.99):
        out = out.union(stats.nearest_rank(gaps, "gap", p).select(F.lit(p).alias("p"), "value"))
    return out


def block_bootstrap(spark, d):
    r = book_events(spark, d).groupBy(F.floor(F.col("exchange_ts_ns") / (24 * HOUR)).alias("day")).agg((F.avg("qty") - 49.0).alias("r"))
    return stats.bootstrap(r, "r", "day", 3).select("p_value", F.round("mean", 9).alias("mean"), "n")


QUERIES = {f.__name__: f for f in (
    forward_labels, labelled_features, signal_zoo, ofi_zscore, ofi_zscore_by_symbol, purged_folds, leak_check, signal_fold_metrics, signal_aggregate, top_signals, sharpe_moments, deflated_sharpe, pbo,
    capacity_sweep, capacity_ceiling, calibrated_impact, proxy_sharpe, ablation, latency_histogram, histogram_quantiles, nearest_rank, block_bootstrap,
)}

_H = ", ".join(f"({h})" for h in HORIZONS)
ROWS_SQL = OFI_SQL + _KYLE[len(TWO_SQL) :] + """,
fr AS (SELECT ofi2.*, kl.kyle_raw, avg(ofi) OVER z zm, var_pop(ofi) OVER z zv, count(*) OVER z zn, CASE
        WHEN bid_qty + ask_qty > 0 THEN CAST(ask_price * bid_qty + bid_price * ask_qty AS DOUBLE) / (bid_qty + ask_qty) ELSE mid END micro,
        CAST(ask_price - bid_price AS DOUBLE) spread FROM ofi2 JOIN kl USING (arrival, symbol) WINDOW z AS (ORDER BY arrival ROWS BETWEEN 99 PRECEDING
        AND CURRENT ROW))"""
LABELS_SQL = f""",
lb0 AS (SELECT arrival, symbol, ns, first_value(mid) OVER (PARTITION BY symbol, ns ORDER BY arrival) m0, h.h horizon, ns + h.h due FROM fr, (VALUES {_H}) h(h)),
tl AS (SELECT symbol, ns, arg_min(mid, arrival) mid FROM fr GROUP BY ALL),
lb AS (SELECT a.arrival, a.horizon, (b.mid - a.m0) / a.m0 AS label FROM lb0 a ASOF LEFT JOIN tl b ON a.symbol = b.symbol AND b.ns >= a.due)"""
_ZOO = {
    "ofi": "CAST(ofi AS DOUBLE)", "microprice_minus_mid": "micro - mid", "queue_ahead": "CAST(queue_ahead AS DOUBLE)", "ofi_times_spread": "CAST(ofi AS DOUBLE) * spread",
    "bid_ask_imbalance": "CASE WHEN bid_qty + ask_qty > 0 THEN CAST(bid_qty - ask_qty AS DOUBLE) / (bid_qty + ask_qty) ELSE 0.0 END",
    "kyle_lambda": "kyle_raw", "ofi_zscore": "round(CASE WHEN zn >= 2 AND zv > 1e-12 THEN (ofi - zm) / sqrt(zv) "
        "ELSE 0.0 END, 9)", "microprice_spread_adj": "CASE WHEN spread > 0 THEN (micro - mid) / spread ELSE 0.0 END",
    "sign_microprice_minus_mid": "CAST(sign(micro - mid) AS DOUBLE)", "queue_over_spread": "queue_ahead / greatest(1.0, spread)",
}
# Of the three sequential signals: the mean that trades move and the toxicity of volume buckets, carried on to later rows.
_TOX, _EMA = (MARKET_SQL[k].split(TWO_SQL, 1)[1].rsplit("\nSELECT", 1)[0] for k in ("vpin", "effective_spread_ema"))
_EMA = _EMA.replace("tr AS", "te AS").replace("FROM tr", "FROM te").replace("ls AS", "le AS")
_CARRIED = _EMA + _TOX + """, sq AS (SELECT le.arrival, coalesce(list_reduce(le.l, lambda x, y: 0.95 * x + (1 - 0.95) * y), 0.0) es,
    coalesce(last_value(v.vp IGNORE NULLS) OVER (PARTITION BY le.symbol ORDER BY le.arrival ROWS UNBOUNDED PRECEDING), 0.0) vp
    FROM le LEFT JOIN (SELECT arrival, coalesce(list_aggregate(list_slice(l, -32, -1), 'avg'), 0.0) vp FROM ls
        WHERE arrival IS NOT NULL) v ON v.arrival = le.arrival)"""
_SEQUENTIAL = " UNION ALL ".join(f"SELECT arrival, '{n}', round({e}, 9) "
    f"FROM sq" for n, e in (("effective_spread", "es"), ("neg_effective_spread", "0.0 - es"), ("vpin", "vp")))
SIGNALS_SQL = ", sg AS (" + " UNION ALL ".join(f"SELECT arrival, '{n}' AS signal, {e} AS value FROM fr" for n, e in _ZOO.items()) + ")"
EVERY_SIGNAL_SQL = _CARRIED + SIGNALS_SQL[:-1] + f" UNION ALL {_SEQUENTIAL})"
FOLDS_SQL = ", fo AS (SELECT arrival, ns, least((row_number() OVER (ORDER BY ns, arrival) - 1) // greatest(1, count(*) OVER () // 5), 4) fold FROM fr)"
PAIRS_SQL = LABELS_SQL + EVERY_SIGNAL_SQL + FOLDS_SQL + """,
pr AS (SELECT s.signal, l.horizon, f.fold, s.arrival, s.value, l.label FROM sg s JOIN lb l USING (arrival) JOIN fo f USING (arrival)
        WHERE l.label IS NOT NULL)"""
METRICS_SQL = PAIRS_SQL + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY signal, horizon, fold ORDER BY value, arrival) up, count(*) OVER (PARTITION BY signal, horizon, fold) n,
        greatest(1, count(*) OVER (PARTITION BY signal, horizon, fold) // 5) q FROM pr),
me AS (SELECT signal, horizon, fold, CASE WHEN count(*) >= 3 AND var_pop(value) > 0 AND var_pop(label) > 0 THEN corr(value, label)
        ELSE 0.0 END ic, avg(CASE WHEN value * label > 0 THEN 1.0 ELSE 0.0 END) hit_rate,
    CASE WHEN count(*) >= 10 THEN (coalesce(sum(CASE WHEN up > n - q THEN label END), 0) - coalesce(sum(CASE WHEN up <= q THEN label END), 0)) / max(q)
        ELSE 0.0 END quintile_spread, count(*) n FROM rk GROUP BY ALL),
ag AS (SELECT signal, horizon, avg(ic) mean_ic, stddev_pop(ic) std_ic, avg(quintile_spread) mean_spread, stddev_pop(quintile_spread) std_spread,
        count(*) folds FROM me GROUP BY ALL)"""


def _sharpe(x: str) -> str:
    return f"CASE WHEN count({x}) >= 2 AND var_pop({x}) > 0 THEN avg({x}) / sqrt(var_pop({x})) ELSE 0.0 END"


_R = "sign(value) * label"
_COSTED = LABELS_SQL + ", cs AS (SELECT CAST(ofi AS DOUBLE) AS value, spread * 1e-4 spread, label FROM fr JOIN lb USING (arrival) WHERE horizon = 3600000000000 AND label IS NOT NULL)" + f""",
sw AS (SELECT *, sign(value) * p.p * label gross, sign(value) * p.p * label - (abs(sign(value) * p.p) * (0.5 * spread + CASE WHEN spread <= 0 THEN 0.01
        ELSE 0.0 END + 0.0005) + 1e-6 * abs(sign(value) * p.p)) net FROM cs, (VALUES {", ".join(f"(CAST({g} AS DOUBLE))" for g in research.GRID)}) p(p)),
cv AS (SELECT p participation, {_sharpe("gross")} gross_sharpe, {_sharpe("net")} net_sharpe, avg(gross) mean_return FROM sw GROUP BY p)"""
_GAPS = ", gp AS (SELECT CAST(floor((ns - lag(ns) OVER (PARTITION BY symbol ORDER BY arrival)) / 1000) AS BIGINT) gap FROM ev), gg AS (SELECT gap FROM gp WHERE gap > 0)"
_HIST = _GAPS + ", hi AS (SELECT CAST(floor(log2(gap)) AS BIGINT) bucket, count(*) n FROM gg GROUP BY ALL)"
_Z = "CASE WHEN n >= 2 AND v > 1e-12 THEN (ofi - m) / sqrt(v) ELSE 0.0 END"


def _z(part: str) -> str:
    return f"SELECT arrival, round({_Z}, 6) ofi_zscore FROM (SELECT arrival, ofi, avg(ofi) OVER w m, var_pop(ofi) OVER w v, count(*) OVER w n FROM fr WINDOW w AS ({part} ORDER BY arrival ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))"


_FOLDED = FOLDS_SQL + f""", wi AS (SELECT fold f, min(ns) a, max(ns) b, greatest(0, min(ns) - {PURGE}) oa, max(ns) + {EMBARGO} ob FROM fo GROUP BY fold),
asg AS (SELECT w.f fold, o.arrival, o.ns, CASE WHEN o.fold = w.f THEN 'test' ELSE 'train' END AS role FROM fo o, wi w
        WHERE o.fold = w.f OR o.ns NOT BETWEEN w.oa AND w.ob)"""
_FULL = ROWS_SQL

#: 2000 rounds of blocks of 3 days; a block begins at the first 60 bits of the MD5 of seed:round:block, modulo the days.
_DAYS = f"""days AS (SELECT ns // {24 * HOUR} AS day, avg(qty) - 49.0 r FROM ev GROUP BY 1),
placed AS (SELECT row_number() OVER (ORDER BY day) i, r FROM days),
sums AS (SELECT 0 i, 0.0::DOUBLE upto UNION ALL SELECT i, sum(r) OVER (ORDER BY i) FROM placed),
whole_ AS (SELECT count(*) n, (count(*) + 2) // 3 blocks, sum(r) whole FROM placed),
drawn AS (SELECT k // blocks round_, n, whole, CASE WHEN k % blocks = blocks - 1 THEN n - 3 * (blocks - 1) ELSE 3 END size,
    CAST('0x' || substr(md5('7:' || (k // blocks) || ':' || (k % blocks)), 1, 15) AS BIGINT) % n s FROM (SELECT *, unnest(range(2000 * blocks)) k
        FROM whole_))"""

ORACLE_SQL = {k: tape_sql("," + v[0], v[1]).replace("WITH ", "WITH RECURSIVE ", 1) for k, v in {
    "forward_labels": (_FULL + LABELS_SQL, "SELECT arrival, horizon, round(label, 10) AS label FROM lb"),
    "labelled_features": (_FULL + LABELS_SQL, "SELECT f.arrival, f.symbol, f.mid, " + ", ".join(f"round(max(CASE "
        f"WHEN horizon = {h} THEN label END), 10) label_{k}" for k, h in enumerate(HORIZONS)) + " FROM fr f JOIN lb USING (arrival) GROUP BY ALL"),
    "ofi_zscore": (_FULL, _z("")),
    "ofi_zscore_by_symbol": (_FULL, _z("PARTITION BY symbol")),
    "purged_folds": (_FULL + _FOLDED, "SELECT fold, role, count(*) n, min(ns) lo, max(ns) hi, CAST(sum(arrival) AS BIGINT) arrivals FROM asg GROUP BY ALL"),
    "leak_check": (_FULL + _FOLDED, f"SELECT t.fold, count(CASE WHEN t.ns <= w.b AND t.ns + {6 * HOUR} >= w.a THEN 1 END) n_leaks FROM asg t "
        f"JOIN wi w ON w.f = t.fold WHERE t.role = 'train' GROUP BY ALL"),
    "signal_fold_metrics": (_FULL + METRICS_SQL, "SELECT signal, horizon, fold, round(ic, 6) ic, round(hit_rate, 6) hit_rate, round(quintile_spread, "
        "8) quintile_spread, n FROM me"),
    "signal_aggregate": (_FULL + METRICS_SQL, "SELECT signal, horizon, round(mean_ic, 6) mean_ic, round(std_ic, 6) std_ic, round(mean_spread, 8) mean_spread, "
        "round(std_spread, 8) std_spread, folds FROM ag"),
    "top_signals": (_FULL + METRICS_SQL, "SELECT signal, horizon, round(mean_ic, 6) mean_ic FROM ag ORDER BY ag.mean_ic DESC, signal, horizon LIMIT 10"),
    "sharpe_moments": (_FULL + PAIRS_SQL + f""", rr AS (SELECT signal, horizon, {_R} r, avg({_R}) OVER (PARTITION BY signal, horizon) m FROM pr),
        mo AS (SELECT signal, horizon, avg(r) a, avg((r - m) ** 2) v, avg((r - m) ** 3) c, avg((r - m) ** 4) k, count(*) n FROM rr GROUP BY ALL)""",
        "SELECT signal, horizon, round(CASE WHEN n >= 2 AND v > 0 THEN a / sqrt(v) ELSE 0.0 END, 5) sharpe, round(CASE WHEN n >= 3 "
            "AND v > 0 THEN c / v ** 1.5 ELSE 0.0 END, 5) skew, round(CASE WHEN n >= 4 AND v > 0 THEN k / (v * v) - 3 ELSE 0.0 END, 5) kurtosis, n FROM mo"),
    "pbo": (_FULL + METRICS_SQL + ", bs AS (SELECT a.fold, max(a.ic) i, max(b.ic) o FROM me a JOIN me b ON a.signal = b.signal AND a.horizon = b.horizon "
        "AND b.fold = a.fold + 1 WHERE a.horizon = 3600000000000 GROUP BY a.fold)", "SELECT round(coalesce(avg(CASE WHEN i > o THEN 1.0 "
            "ELSE 0.0 END), 0.5), 6) pbo, count(*) comparisons FROM bs"),
    "capacity_sweep": (_FULL + _COSTED, "SELECT participation, round(gross_sharpe, 6) gross_sharpe, round(net_sharpe, 6) net_sharpe, round(mean_return, "
        "10) mean_return FROM cv"),
    "capacity_ceiling": (_FULL + _COSTED, "SELECT coalesce(max(CASE WHEN net_sharpe > 0 THEN participation END), 0.0) ceiling FROM cv"),
    "calibrated_impact": (_FULL, "SELECT round(coalesce(avg(CASE WHEN spread > 0 THEN spread END) * 1e-7, 1e-6), 12) impact_lambda FROM fr"),
    "proxy_sharpe": (_FULL + PAIRS_SQL, f"SELECT signal, fold, round({_sharpe(_R)}, 6) sharpe, count(*) // 100 fills FROM pr "
        f"WHERE horizon = 3600000000000 GROUP BY ALL"),
    "ablation": (_FULL + METRICS_SQL + f", ps AS (SELECT fold, {_sharpe(_R)} s FROM pr WHERE horizon = 3600000000000 AND signal = 'ofi' "
        f"GROUP BY fold), zq AS (SELECT fold, CASE WHEN count(*) >= 10 THEN (sum(CASE WHEN up > n - q THEN label END) - sum(CASE "
            f"WHEN up <= q THEN label END)) / max(q) ELSE 0.0 END z FROM (SELECT *, row_number() OVER (PARTITION BY fold "
                f"ORDER BY arrival) up, count(*) OVER (PARTITION BY fold) n, greatest(1, count(*) OVER (PARTITION BY fold) // 5) q FROM pr "
                    f"WHERE horizon = 3600000000000 AND signal = 'ofi') GROUP BY fold), mm AS (SELECT * FROM me WHERE horizon = 3600000000000 "
                        f"AND signal = 'ofi')",
        "SELECT v variant, round(CASE WHEN z THEN 0.0 ELSE (SELECT avg(ic) FROM mm) END, 6) mean_ic, round(CASE WHEN z THEN (SELECT avg(z) FROM zq) "
            "ELSE (SELECT avg(quintile_spread) FROM mm) END, 8) mean_spread, round(CASE WHEN z THEN 0.0 ELSE (SELECT avg(s) FROM ps) END, 6) net_sharpe "
                "FROM (VALUES ('full_signal', false), ('ablate_ofi_component', true), ('ablate_microprice_component', false)) t(v, z)"
        f""" UNION ALL SELECT variant, round((SELECT avg(ic) FROM mm), 6), round((SELECT avg(quintile_spread) FROM mm), 8), round(s, 6) FROM (
            SELECT 'no_cost_model' variant, {_sharpe("sign(value) * 0.01::DOUBLE * label")} s FROM pr WHERE horizon = 3600000000000 AND signal = 'ofi'
            UNION ALL SELECT 'phase0_ofi_baseline', {_sharpe(_R)} FROM pr WHERE horizon = 3600000000000 AND signal = 'ofi')"""),
    "latency_histogram": (_HIST[1:], "SELECT bucket, n, CAST(2.0 ** bucket AS DOUBLE) low FROM hi"),
    "histogram_quantiles": (_HIST[1:], "SELECT CAST(p AS DOUBLE) p, CAST(2.0 ** min(bucket) AS DOUBLE) quantile "
        "FROM (SELECT bucket, sum(n) OVER (ORDER BY bucket) u, sum(n) OVER () a FROM hi), (VALUES (0.5), (0.9), (0.99)) t(p) "
            "WHERE u >= ceil(a * CAST(p AS DOUBLE)) GROUP BY p"),
    "block_bootstrap": (_DAYS, f"""SELECT avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0.0 END) p_value, round(avg(m), 9) mean, any_value(n) n FROM
        (SELECT round_, any_value(n) n, sum(b.upto - a.upto + CASE WHEN s + size > n THEN whole ELSE 0.0 END) / any_value(n) m FROM drawn
            JOIN sums a ON a.i = s JOIN sums b ON b.i = CASE WHEN s + size > n THEN s + size - n ELSE s + size END GROUP BY round_)"""),
    "nearest_rank": (_GAPS[1:], "SELECT CAST(p AS DOUBLE) p, max(CASE "
        "WHEN rn - 1 = CAST(floor(CAST(p AS DOUBLE) * (n - 1)) AS BIGINT) THEN gap END) AS value FROM (SELECT gap, row_number() OVER (ORDER BY gap) rn, "
            "count(*) OVER () n FROM gg), (VALUES (0.5), (0.9), (0.99)) t(p) GROUP BY p"),
}.items()}

ORACLE_SQL["signal_zoo"] = tape_sql("," + _FULL + SIGNALS_SQL + _CARRIED, f"SELECT arrival, signal, round(value, 9) AS value FROM sg "
    f"UNION ALL {_SEQUENTIAL}").replace("WITH ", "WITH RECURSIVE ", 1)

# The normal distribution function by its series of positive terms, z^(2k+1) / (2k+1)!!.
_PHI = "CASE WHEN abs(z) > 8 THEN CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END WHEN z = 0 THEN 0.5 ELSE 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 300), lambda k: exp((2 * k + 1) * ln(abs(z)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)))) END"
ORACLE_SQL["deflated_sharpe"] = tape_sql("," + _FULL + PAIRS_SQL + f""", rr AS (SELECT signal, horizon, {_R} r, avg({_R}) OVER (PARTITION BY signal,
        horizon) m FROM pr),
    mo AS (SELECT signal, horizon, avg(r) a, avg((r - m) ** 2) v, avg((r - m) ** 3) c, avg((r - m) ** 4) k, count(*) n FROM rr GROUP BY ALL),
    ms AS (SELECT signal, horizon, n, CASE WHEN n >= 2 AND v > 0 THEN a / sqrt(v) ELSE 0.0 END sr, CASE WHEN n >= 3 AND v > 0 THEN c / v ** 1.5
        ELSE 0.0 END skew, CASE WHEN n >= 4 AND v > 0 THEN k / (v * v) - 3 ELSE 0.0 END kurt FROM mo),
    one AS (SELECT *, (sr - (skew / 6 * sr + kurt / 24 * sr * sr)) * sqrt((n - 1) / (n - 2)) adjusted, (SELECT stddev_pop(sr)
        FROM ms) sd, sqrt(2 * ln((SELECT count(*) FROM ms) * 5)) w FROM ms ORDER BY round(sr, 9) DESC, signal DESC LIMIT 1),
    ex AS (SELECT *, sd * ((1 - 0.5772156649015329) * w + 0.5772156649015329 / w) expected_max FROM one), zz AS (SELECT *,
        (adjusted - expected_max) * sqrt(n - 1) z FROM ex)""",
    f"SELECT signal, horizon, round(adjusted, 6) adjusted, round(expected_max, 6) expected_max, round(z, 6) z, round(1 - ({_PHI}), 6) p_value "
        f"FROM zz").replace("WITH ", "WITH RECURSIVE ", 1)
