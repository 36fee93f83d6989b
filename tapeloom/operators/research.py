"""Labels, signals, purged folds, evaluation, costs and ablation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tapeloom.functions.ranks import global_rank, trailing
from tapeloom.functions.stats import pearson, sharpe
from tapeloom.shared import stored

SECOND = 1_000_000_000
HORIZONS = (1 * SECOND, 5 * SECOND, 10 * SECOND)
PURGE, EMBARGO, FOLDS = 2 * SECOND, 1 * SECOND, 5
Z_ROWS = 100


def with_mid(features: DataFrame) -> DataFrame:
    both = (F.col("bid_price") != 0) & (F.col("ask_price") != 0)
    return features.withColumn("mid", F.when(both, (F.col("bid_price") + F.col("ask_price")) / 2.0).otherwise(0.0))


# -- labels -----------------------------------------------------------------------------------------------------
def forward_labels(rows: DataFrame, horizons=HORIZONS, key: str = "arrival") -> DataFrame:
    """(key, symbol, exchange_ts_ns, horizon, label): relative change from the mid first seen at a row's time to the first at or after the horizon.

    Rows without a mid have no label. Origins and targets are merged and filled backwards: one shuffle by symbol for all horizons.
    """
    line = rows.where("mid > 0").select(key, "symbol", F.col("exchange_ts_ns").alias("t"), "mid")
    origin = F.first("mid").over(Window.partitionBy("symbol", "t").orderBy(key))
    asked = line.withColumn("from_mid", origin).withColumn("horizon", F.explode(F.array(*(F.lit(int(h)).cast("long") for h in horizons))))
    asked = asked.select("symbol", (F.col("t") + F.col("horizon")).alias("at"), F.lit(1).alias("side"), F.col(key).alias("k"), "horizon", "from_mid", F.col("t"), F.lit(None).cast("double").alias("to_mid"))
    given = line.select("symbol", F.col("t").alias("at"), F.lit(0).alias("side"), F.col(key).alias("k"), F.lit(None).cast("long").alias("horizon"), F.lit(None).cast("double").alias("from_mid"), "t", F.col("mid").alias("to_mid"))
    backwards = Window.partitionBy("symbol").orderBy(F.desc("at"), "side", F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    met = given.unionByName(asked).withColumn("to_mid", F.last("to_mid", ignorenulls=True).over(backwards)).where("side = 1")
    return met.select(F.col("k").alias(key), "symbol", F.col("t").alias("exchange_ts_ns"), "horizon", ((F.col("to_mid") - F.col("from_mid")) / F.col("from_mid")).alias("label"))


def labelled_features(features: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Features with mid and an array of labels, one a horizon, null where there is none."""
    rows = with_mid(features)
    long = forward_labels(rows, horizons).groupBy("arrival").pivot("horizon", [int(h) for h in horizons]).agg(F.first("label"))
    return rows.join(long.select("arrival", F.array(*(F.col(f"`{int(h)}`") for h in horizons)).alias("labels")), "arrival", "left")


# -- signals ----------------------------------------------------------------------------------------------------
def spread(compat: bool = False) -> Column:
    """Offer less bid; in compat mode a crossed market wraps around 32 bits as the unsigned difference does."""
    s = F.col("ask_price") - F.col("bid_price")
    return (F.when(s < 0, s + (1 << 32)).otherwise(s) if compat else s).cast("double")


def _zoo(compat: bool) -> dict[str, Column]:
    s, lean = spread(compat), F.col("microprice") - F.col("mid")
    size = (F.col("bid_qty") + F.col("ask_qty")).cast("double")
    return {
        "ofi": F.col("ofi"),
        "microprice_minus_mid": lean,
        "queue_ahead": F.col("queue_ahead"),
        "effective_spread": F.col("effective_spread"),
        "kyle_lambda": F.col("kyle_lambda"),
        "vpin": F.col("vpin"),
        "ofi_zscore": F.col("ofi_zscore"),
        "microprice_spread_adj": F.when(s > 0, lean / F.nullif(s, F.lit(0.0))).otherwise(0.0),
        "ofi_times_spread": F.col("ofi") * s,
        "sign_microprice_minus_mid": F.signum(lean),
        "neg_effective_spread": -F.col("effective_spread"),
        "queue_over_spread": F.col("queue_ahead") / F.greatest(F.lit(1.0), s),
        "bid_ask_imbalance": F.when(size > 0, (F.col("bid_qty") - F.col("ask_qty")) / F.nullif(size, F.lit(0.0))).otherwise(0.0),
    }


class SignalRegistry:
    """Named signals: functions that give a Column over labelled feature rows."""

    def __init__(self, compat: bool = False):
        self.signals: dict[str, Callable[[], Column]] = {n: (lambda c=c: c) for n, c in _zoo(compat).items()}

    def add(self, name: str, build: Callable[[], Column]) -> None:
        """A user's signal; `build` may use windows, or wrap a pandas UDF."""
        if name in self.signals:
            raise ValueError(f"{name} is taken")
        self.signals[name] = build

    def wide(self, rows: DataFrame, names=None) -> DataFrame:
        return rows.select("arrival", "symbol", "exchange_ts_ns", *(self.signals[n]().cast("double").alias(n) for n in names or self.signals))

    def long(self, rows: DataFrame, names=None) -> DataFrame:
        """(arrival, symbol, exchange_ts_ns, signal, value): all signals in one pass, to be evaluated by one aggregation."""
        return self.wide(rows, names).unpivot(["arrival", "symbol", "exchange_ts_ns"], list(names or self.signals), "signal", "value")


def with_zscore(rows: DataFrame, by_symbol: bool = False, n: int = Z_ROWS, block: int = 100_000) -> DataFrame:
    """Adds ofi_zscore over the last n rows of all symbols, or of each symbol; 0 for one row or no deviation.

    The window over all symbols is cut into blocks of ranks that lend each other their last rows, so no task holds the whole tape.
    """
    names = {"__mean": F.avg("ofi"), "__var": F.var_pop("ofi"), "__n": F.count("ofi")}
    if by_symbol:
        w = Window.partitionBy("symbol").orderBy("arrival").rowsBetween(-(n - 1), 0)
        rows = rows.select("*", *(a.over(w).alias(k) for k, a in names.items()))
    else:
        rows = trailing(global_rank(rows, "arrival", [], "__rank"), "__rank", n, block, names).drop("__rank")
    z = (F.col("ofi") - F.col("__mean")) / F.sqrt(F.nullif(F.col("__var"), F.lit(0.0)))
    return rows.withColumn("ofi_zscore", F.when((F.col("__n") >= 2) & (F.col("__var") > 1e-12), z).otherwise(0.0)).drop("__mean", "__var", "__n")


# -- folds ------------------------------------------------------------------------------------------------------
def test_folds(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Adds fold: equal counts in order of time and arrival, what is left over in the last."""
    if folds < 2:
        raise ValueError("at least two folds")
    ranked = global_rank(rows, "exchange_ts_ns", ["arrival"], "__rank")
    total = rows.agg(F.count("*").alias("__n"))
    size = F.greatest(F.lit(1), F.floor(F.col("__n") / folds))
    return ranked.join(F.broadcast(total)).withColumn("fold", F.least(F.floor((F.col("__rank") - 1) / size), F.lit(folds - 1)).cast("int")).drop("__rank", "__n")


def fold_windows(tested: DataFrame, purge: int = PURGE, embargo: int = EMBARGO) -> DataFrame:
    """Test interval of each fold and the interval around it that training leaves out. A row a fold."""
    t = tested.groupBy("fold").agg(F.min("exchange_ts_ns").alias("test_start"), F.max("exchange_ts_ns").alias("test_end"))
    return t.select("fold", "test_start", "test_end", F.greatest(F.lit(0), F.col("test_start") - purge).alias("out_start"), (F.col("test_end") + embargo).alias("out_end"))


def purged_folds(rows: DataFrame, folds: int = FOLDS, purge: int = PURGE, embargo: int = EMBARGO) -> DataFrame:
    """(fold, arrival, exchange_ts_ns, role): a row is tested in one fold and trains in those whose interval it is outside of.

    There are `folds` windows, a handful, so they are broadcast.
    """
    tested = test_folds(rows, folds)
    windows = fold_windows(tested, purge, embargo).withColumnRenamed("fold", "of")
    met = tested.select("arrival", "exchange_ts_ns", "fold").join(F.broadcast(windows))
    role = F.when(F.col("fold") == F.col("of"), "test").when(~F.col("exchange_ts_ns").between(F.col("out_start"), F.col("out_end")), "train")
    return met.withColumn("role", role).where("role IS NOT NULL").select(F.col("of").alias("fold"), "arrival", "exchange_ts_ns", "role")


def leaks(assigned: DataFrame, horizon: int) -> DataFrame:
    """(fold, n_leaks): training rows whose label interval overlaps the fold's test interval."""
    test = assigned.where("role = 'test'").groupBy("fold").agg(F.min("exchange_ts_ns").alias("lo"), F.max("exchange_ts_ns").alias("hi"))
    over = (F.col("exchange_ts_ns") <= F.col("hi")) & (F.col("exchange_ts_ns") + horizon >= F.col("lo"))
    return assigned.where("role = 'train'").join(F.broadcast(test), "fold").groupBy("fold").agg(F.count(F.when(over, 1)).alias("n_leaks"))


# -- evaluation ---------------------------------------------------------------------------------------------------
def evaluation_rows(wide: DataFrame, labels: DataFrame, tested: DataFrame, names) -> DataFrame:
    """(signal, horizon, fold, arrival, value, label) of valid pairs on test rows, for a column a signal.

    Rows meet before they are unpivoted, so what is shuffled does not grow with the number of signals.
    """
    cells = wide.select("arrival", *names).join(tested.select("arrival", "fold"), "arrival").join(labels.select("arrival", "horizon", "label"), "arrival")
    pairs = cells.where(F.col("label").isNotNull() & ~F.isnan("label")).unpivot(["arrival", "fold", "horizon", "label"], list(names), "signal", "value")
    return pairs.where(F.col("value").isNotNull() & ~F.isnan("value")).select("signal", "horizon", "fold", "arrival", "value", "label")


def fold_metrics(pairs: DataFrame) -> DataFrame:
    """Information coefficient, hit rate, quintile spread and count by signal, horizon and fold."""
    key = ["signal", "horizon", "fold"]
    group = Window.partitionBy(*key)
    n = F.count("*").over(group)
    q = F.greatest(F.lit(1), F.floor(n / 5))
    up = F.row_number().over(group.orderBy("value", "arrival"))
    ranked = pairs.withColumn("n", n).withColumn("q", q).withColumn("up", up)
    top, bottom = F.when(F.col("up") > F.col("n") - F.col("q"), F.col("label")), F.when(F.col("up") <= F.col("q"), F.col("label"))
    return ranked.groupBy(*key).agg(
        pearson(F.col("value"), F.col("label")).alias("ic"),
        F.avg(F.when(F.col("value") * F.col("label") > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
        F.when(F.count("*") >= 10, (F.sum(top) - F.sum(bottom)) / F.max("q")).otherwise(0.0).alias("quintile_spread"),
        F.count("*").alias("n"),
    )


def aggregate_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("signal", "horizon").agg(
        F.avg("ic").alias("mean_ic"), F.stddev_pop("ic").alias("std_ic"), F.avg("quintile_spread").alias("mean_spread"), F.stddev_pop("quintile_spread").alias("std_spread"), F.count("*").alias("folds")
    )


def top_signals(aggregates: DataFrame, n: int = 10) -> DataFrame:
    return aggregates.orderBy(F.desc("mean_ic"), "signal", "horizon").limit(n)


# -- costs --------------------------------------------------------------------------------------------------------
GRID = (0.01, 0.05, 0.10, 0.25, 0.50, 1.0)
HALF_SPREAD_BPS, IMPACT, DEFAULT_SPREAD = 5.0, 1e-6, 0.01


def trading_cost(qty: Column, spread: Column, compat: bool = False, impact: float = IMPACT) -> Column:
    """Half the spread and basis points on what is crossed, and linear impact. In compat mode short positions earn the crossing."""
    half = 0.5 * spread + F.when(spread <= 0, DEFAULT_SPREAD).otherwise(0.0)
    return (qty if compat else F.abs(qty)) * (half + HALF_SPREAD_BPS * 1e-4) + impact * F.abs(qty)


def capacity_sweep(pairs: DataFrame, grid=GRID, compat: bool = False) -> DataFrame:
    """For rows (value, label, spread): Sharpe ratios and mean by participation. Each row is expanded in place: no join."""
    each = pairs.withColumn("participation", F.explode(F.array(*(F.lit(float(g)) for g in grid))))
    qty = F.signum("value") * F.col("participation")
    gross = qty * F.col("label")
    each = each.withColumn("gross", gross).withColumn("net", gross - trading_cost(qty, F.col("spread"), compat))
    return each.groupBy("participation").agg(sharpe(F.col("gross")).alias("gross_sharpe"), sharpe(F.col("net")).alias("net_sharpe"), F.avg("gross").alias("mean_return"))


def capacity_ceiling(curve: DataFrame) -> DataFrame:
    return curve.agg(F.coalesce(F.max(F.when(F.col("net_sharpe") > 0, F.col("participation"))), F.lit(0.0)).alias("ceiling"))


def calibrated_impact(rows: DataFrame, value: str = "spread") -> DataFrame:
    return rows.agg((F.coalesce(F.avg(F.when(F.col(value) > 0, F.col(value))) * 1e-7, F.lit(IMPACT))).alias("impact_lambda"))


def proxy_sharpe(pairs: DataFrame) -> DataFrame:
    """By signal and fold: Sharpe ratio of the signal's sign times the label, and rows div 100 as fills."""
    r = F.signum("value") * F.col("label")
    return pairs.groupBy("signal", "fold").agg(sharpe(r).alias("sharpe"), F.floor(F.count("*") / 100).alias("fills"))


def ablation(pairs: DataFrame, signal: str) -> DataFrame:
    """(variant, mean_ic, mean_spread, net_sharpe) of one signal at one horizon, whole and with a component zeroed."""
    own = pairs.where(F.col("signal") == signal)
    variants = {"full_signal": False, "ablate_ofi_component": "ofi" in signal, "ablate_microprice_component": "microprice" in signal}
    each = own.withColumn("v", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(z).alias("zero")) for n, z in variants.items()))))
    each = each.withColumn("value", F.when(F.col("v.zero"), 0.0).otherwise(F.col("value"))).withColumn("signal", F.col("v.name")).drop("v")
    metrics = fold_metrics(each).join(proxy_sharpe(each).drop("fills"), ["signal", "fold"])
    return metrics.groupBy(F.col("signal").alias("variant")).agg(F.avg("ic").alias("mean_ic"), F.avg("quintile_spread").alias("mean_spread"), F.avg("sharpe").alias("net_sharpe"))


def ablation_report(pairs: DataFrame, signal: str, spreads: DataFrame, baseline_sharpe: Column, order: str = "arrival") -> DataFrame:
    """ablation(), and two rows more with the whole signal's coefficients: without costs (the gross ratio at the first participation of the
    sweep), and the ratio of a baseline, an aggregate over all of `pairs` of the signal.

    spreads: (arrival, spread) of the rows.
    """
    own = stored(pairs.where(F.col("signal") == signal), "ablation-pairs")
    parts = stored(ablation(own, signal), "ablation")
    gross = capacity_sweep(own.select(order, "value", "label").join(spreads, order), GRID[:1]).select(F.col("gross_sharpe").alias("net_sharpe"))
    whole = parts.where("variant = 'full_signal'").select("mean_ic", "mean_spread")
    more = gross.select(F.lit("no_cost_model").alias("variant"), "net_sharpe").union(own.agg(baseline_sharpe.alias("net_sharpe")).select(F.lit("phase0_ofi_baseline"), "net_sharpe"))
    return parts.unionByName(more.join(F.broadcast(whole)).select("variant", "mean_ic", "mean_spread", "net_sharpe"))  # one row
