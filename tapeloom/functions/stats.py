"""Statistics of signals and strategies."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tapeloom.functions.ranks import global_rank
from tapeloom.shared import stored

EULER = 0.5772156649015329


def ratio(up: Column, down: Column) -> Column:
    """up / down, 0 where down is 0 or nothing."""
    return F.coalesce(up / F.nullif(down, F.lit(0.0)), F.lit(0.0))


def sharpe(x: Column) -> Column:
    """Mean over population deviation; 0 for fewer than two values or none but equal ones."""
    return F.when((F.count(x) >= 2) & (F.var_pop(x) > 0), F.avg(x) / F.sqrt(F.nullif(F.var_pop(x), F.lit(0.0)))).otherwise(0.0)


def skewness(x: Column) -> Column:
    return F.when((F.count(x) >= 3) & (F.var_pop(x) > 0), F.skewness(x)).otherwise(0.0)


def excess_kurtosis(x: Column) -> Column:
    return F.when((F.count(x) >= 4) & (F.var_pop(x) > 0), F.kurtosis(x)).otherwise(0.0)


def pearson(x: Column, y: Column) -> Column:
    """Correlation; 0 for fewer than three pairs or where a side does not vary."""
    both = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    scale = F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    return F.when(both >= 3, F.coalesce(F.covar_pop(x, y) / scale, F.lit(0.0))).otherwise(0.0)


def hit_rate(x: Column, y: Column) -> Column:
    """Share of pairs of one sign; a zero is a miss."""
    return F.coalesce(F.avg(F.when(x * y > 0, 1.0).otherwise(0.0)), F.lit(0.0))


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def deflated_sharpe(sr: float, skew: float, kurtosis: float, n: int, trials: int, trials_std: float) -> dict:
    """Sharpe ratio after correction for moments and for the best of many trials; n must exceed 2."""
    if n <= 2 or trials < 1:
        return {"adjusted": 0.0, "expected_max": 0.0, "z": 0.0, "p_value": 1.0}
    adjusted = (sr - (skew / 6 * sr + (kurtosis - 3) / 24 * sr * sr)) * math.sqrt((n - 1) / (n - 2))
    spread = math.sqrt(2 * math.log(trials)) if trials > 1 else 0.0
    expected = trials_std * ((1 - EULER) * spread + (EULER / spread if spread else 0.0))
    z = (adjusted - expected) * math.sqrt(n - 1)
    return {"adjusted": adjusted, "expected_max": expected, "z": z, "p_value": 1 - normal_cdf(z)}


def overfit_probability(scores: DataFrame) -> DataFrame:
    """For rows (fold, is_score, oos_score): share of folds whose best in-sample score exceeds the best out of sample; 0.5 without folds."""
    best = scores.groupBy("fold").agg(F.max("is_score").alias("i"), F.max("oos_score").alias("o")).where("i IS NOT NULL AND o IS NOT NULL")
    return best.agg(F.coalesce(F.avg(F.when(F.col("i") > F.col("o"), 1.0).otherwise(0.0)), F.lit(0.5)).alias("pbo"), F.count("*").alias("comparisons"))


def risk_metrics(returns: DataFrame, equity: DataFrame, trades: DataFrame) -> DataFrame:
    """One row: returns (r), equity (at, equity), trades (pnl). Drawdown is from the running peak, which starts at the first point."""
    down = F.when(F.col("r") < 0, F.col("r") * F.col("r"))
    r = returns.agg(sharpe(F.col("r")).alias("sharpe"), ratio(F.avg("r"), F.sqrt(F.avg(down))).alias("sortino"), F.count("r").alias("n_returns"))
    t = trades.agg(F.coalesce(F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)), F.lit(0.0)).alias("win_rate"), F.coalesce(F.avg("pnl"), F.lit(0.0)).alias("avg_trade"), F.count("pnl").alias("n_trades"))
    return r.join(drawdown(equity)).join(t)


def drawdown(equity: DataFrame, at: str = "at", value: str = "equity") -> DataFrame:
    """Largest fall from the running peak. Ranges of `at` are reduced to (peak, trough, fall) first and folded in order."""
    span = equity.agg(F.min(at).alias("low"), F.max(at).alias("high"))
    each = equity.join(F.broadcast(span)).withColumn("part", F.floor((F.col(at) - F.col("low")) / ((F.col("high") - F.col("low") + 1) / F.lit(256.0))))
    inside = Window.partitionBy("part").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("fall", F.max(value).over(inside) - F.col(value))
    parts = each.groupBy("part").agg(F.max(value).alias("peak"), F.min(value).alias("trough"), F.max("fall").alias("fall"))
    ahead = F.max("peak").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("ahead", ahead).agg(F.coalesce(F.max(F.greatest("fall", F.col("ahead") - F.col("trough"))), F.lit(0.0)).alias("max_drawdown"))


PREFIX_BLOCK = 1 << 16


def prefix_sums(series: DataFrame, value: str, order: str) -> DataFrame:
    """(at, upto): the sum of the first `at` values in the order of a whole-number column, for 0 and every count.

    Blocks of PREFIX_BLOCK ranks are summed apart; one row a block is carried on.
    """
    ranked = global_rank(series.select(F.col(order).cast("long").alias("o"), F.col(value).cast("double").alias("x")), "o", ["x"], "at")
    blocks = ranked.withColumn("block", F.expr(f"(at - 1) div {PREFIX_BLOCK}"))
    sums = blocks.groupBy("block").agg(F.sum("x").alias("own"))
    ahead = F.coalesce(F.sum("own").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # a row a block
    inside = F.sum("x").over(Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    upto = blocks.join(sums.select("block", ahead.alias("ahead")), "block").select("at", (F.col("ahead") + inside).alias("upto"))
    return upto.unionByName(series.sparkSession.range(1).select(F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("upto")))


def block_start(seed: int, number: Column, block: Column, n: int) -> Column:
    """Where a round's block begins: the first 60 bits of the MD5 of `seed:round:block`, modulo n."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), number.cast("string"), block.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % n


def bootstrap(series: DataFrame, value: str, order: str, block: int, rounds: int = 2000, seed: int = 7) -> DataFrame:
    """p-value of a mean above 0 by circular block bootstrap: share of resample means not above 0; 1 for an empty series.

    A block's sum is the difference of two prefix sums (and the whole, where it goes over the end), so a round is looked up at the two
    ends of its blocks by a join on places; neither the series nor a round is ever in one task.
    """
    series = stored(series.select(value, order), "bootstrap-series")  # counted, spanned, ranked and summed: one pass of what made it
    n = series.count()
    block = max(1, min(block, n))
    blocks = -(-n // block)
    drawn = series.sparkSession.range(rounds * blocks).select(F.expr(f"id div {max(1, blocks)}").alias("round"), (F.col("id") % max(1, blocks)).alias("block"))
    size = F.when(F.col("block") == blocks - 1, n - block * (blocks - 1)).otherwise(block)
    drawn = drawn.select("round", block_start(seed, F.col("round"), F.col("block"), max(1, n)).alias("start"), size.alias("size"))
    end = F.col("start") + F.col("size")
    look = lambda at, sign: F.struct(at.cast("long").alias("at"), F.lit(sign).alias("sign"))
    ends = F.array(look(F.col("start"), -1), F.when(end <= n, look(end, 1)).otherwise(look(end - n, 1)), F.when(end > n, look(F.lit(n), 1)))
    asked = drawn.select("round", F.explode(ends).alias("e")).where("e IS NOT NULL").select("round", "e.at", "e.sign")
    means = asked.join(prefix_sums(series, value, order), "at").groupBy("round").agg((F.sum(F.col("sign") * F.col("upto")) / max(1, n)).alias("mean"))
    share = F.avg(F.when(F.col("mean") <= 0, 1.0).otherwise(0.0))
    return means.agg(F.coalesce(share, F.lit(1.0)).alias("p_value"), F.coalesce(F.avg("mean"), F.lit(0.0)).alias("mean"), F.lit(n).cast("long").alias("n"))


def log2_bucket(x: Column, steps: int = 1) -> Column:
    """Histogram bucket of a positive number: `steps` a power of two."""
    return F.when(x > 0, F.floor(F.log2(x) * steps)).otherwise(0).cast("long")


def histogram(df: DataFrame, value: str, steps: int = 1) -> DataFrame:
    """Counts by bucket; histograms of parts add up to that of the whole."""
    return df.groupBy(log2_bucket(F.col(value), steps).alias("bucket")).agg(F.count("*").alias("n")).withColumn("low", F.pow(F.lit(2.0), F.col("bucket") / F.lit(float(steps))))


def histogram_quantile(hist: DataFrame, p: float) -> DataFrame:
    """Lower value of the first bucket whose running count reaches p of all."""
    upto = F.sum("n").over(Window.orderBy("bucket"))
    every = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return hist.withColumn("upto", upto).withColumn("every", every).where(F.col("upto") >= F.ceil(F.col("every") * F.lit(p))).agg(F.min("low").alias("quantile"))


def order_key(df: DataFrame, value: str, name: str = "key") -> DataFrame:
    """Adds a whole number that orders as the value does: the value itself, or the bits of a fraction (-0 is 0, NaN the largest)."""
    if dict(df.dtypes)[value] not in ("double", "float"):
        return df.withColumn(name, F.col(value).cast("long"))

    @F.pandas_udf("long")
    def bits(x: pd.Series) -> pd.Series:
        raw = np.ascontiguousarray(x.to_numpy(np.float64, na_value=np.nan) + 0.0).view(np.int64)
        return pd.Series(raw ^ ((raw >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))

    return df.withColumn(name, bits(F.col(value).cast("double")))


def nearest_rank(df: DataFrame, value: str, p: float) -> DataFrame:
    """The value at index floor(p * (n - 1)) in ascending order; null values take no part, and of none the result is null.

    Equal values are counted and stored. Then the value is found by its bits, sixteen at a time from the top: counts of the 65536
    leading patterns give the one that holds the index, and only its values go on.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    counts = stored(order_key(counts, value), "rank-counts")
    target = counts.agg(F.floor(F.lit(p) * (F.sum("n") - 1)).cast("long").alias("index"))
    here = counts
    for shift in (48, 32, 16, 0):
        digits = here.withColumn("digits", F.shiftright("key", shift) if shift == 48 else F.shiftright("key", shift).bitwiseAND(F.lit(0xFFFF)))
        upto = F.sum("n").over(Window.orderBy("digits"))  # 65536 rows at most
        sums = digits.groupBy("digits").agg(F.sum("n").alias("n")).withColumn("upto", upto).join(F.broadcast(target)).where("upto > index")
        chosen = sums.agg(F.min_by(F.struct("digits", (F.col("index") - F.col("upto") + F.col("n")).alias("index")), "upto").alias("c")).select("c.digits", "c.index")
        target = chosen.select("index")
        here = digits.join(F.broadcast(chosen.select("digits")), "digits").drop("digits")  # one row
    return here.agg(F.min(value).alias("value"))
