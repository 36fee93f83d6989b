"""Global ranks and frames without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

BUCKETS = 1024


def global_rank(df: DataFrame, order: str, ties: list[str], name: str = "rank") -> DataFrame:
    """Adds the row number, from 1, in the order of a whole-number column and then `ties`.

    Rows are ranked in ranges of the column; only a count a range is summed in one place.
    """
    span = df.agg(F.min(order).alias("__low"), F.max(order).alias("__high"))
    ranged = df.join(F.broadcast(span))  # one row
    ranged = ranged.withColumn("__range", F.floor((F.col(order) - F.col("__low")) / ((F.col("__high") - F.col("__low") + 1) / F.lit(float(BUCKETS)))).cast("int")).drop("__low", "__high")
    counts = ranged.groupBy("__range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__range", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(order, *ties))
    return ranged.join(counts, "__range").withColumn(name, (F.col("__before") + inside).cast("long")).drop("__range", "__before")


def running_max_before(df: DataFrame, order: str, value: str, name: str = "before") -> DataFrame:
    """Adds the largest value of all rows before each in the order of a whole-number column; null for the first.

    Ranges of the column are reduced to their maxima, which are carried into the ranges after them.
    """
    span = df.agg(F.min(order).alias("__low"), F.max(order).alias("__high"))
    ranged = df.join(F.broadcast(span))  # one row
    ranged = ranged.withColumn("__range", F.floor((F.col(order) - F.col("__low")) / ((F.col("__high") - F.col("__low") + 1) / F.lit(float(BUCKETS)))).cast("int")).drop("__low", "__high")
    tops = ranged.groupBy("__range").agg(F.max(value).alias("__top"))
    tops = tops.select("__range", F.max("__top").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__ahead"))
    inside = F.max(value).over(Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.join(tops, "__range").withColumn(name, F.greatest("__ahead", inside)).drop("__range", "__ahead")


def _ranged(df: DataFrame, order: str) -> DataFrame:
    """df with __range, which of BUCKETS ranges of a whole-number column a row lies in."""
    span = df.agg(F.min(order).alias("__low"), F.max(order).alias("__high"))
    width = (F.col("__high") - F.col("__low") + 1) / F.lit(float(BUCKETS))
    return df.join(F.broadcast(span)).withColumn("__range", F.floor((F.col(order) - F.col("__low")) / width).cast("int")).drop("__low", "__high")  # one row


def _back(ranged: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    """Ranged rows with what is known of their range; a null key equals a null key."""
    if not by:
        return ranged.join(ends, "__range")
    named = ends.select(F.col("__range").alias("__r"), *(F.col(c).alias(f"__by_{c}") for c in by), "__ahead")
    same = F.col("__range") == F.col("__r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return ranged.join(named, same).drop("__r", *(f"__by_{c}" for c in by))


def last_before(df: DataFrame, order: str, value: str, name: str = "last", by: list[str] = ()) -> DataFrame:
    """Adds the last value that is not null of all rows (of the same keys) before each in the order of a whole-number column.

    Ranges of the column are reduced to their last values, which are carried into the ranges after them.
    """
    ranged, by = _ranged(df, order), list(by)
    ends = ranged.groupBy("__range", *by).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("__end"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ends = ends.select("__range", *by, F.last("__end", ignorenulls=True).over(before).alias("__ahead"))
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy("__range", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return _back(ranged, ends, by).withColumn(name, F.coalesce(inside, "__ahead")).drop("__range", "__ahead")


def running_sum(df: DataFrame, order: str, value: str, name: str = "sum", by: list[str] = ()) -> DataFrame:
    """Adds the sum of a whole-number column over all rows (of the same keys) up to each, by ranges as last_before() does it."""
    ranged, by = _ranged(df, order), list(by)
    ends = ranged.groupBy("__range", *by).agg(F.sum(value).alias("__own"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ends = ends.select("__range", *by, F.coalesce(F.sum("__own").over(before), F.lit(0)).alias("__ahead"))
    inside = F.sum(value).over(Window.partitionBy("__range", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return _back(ranged, ends, by).withColumn(name, F.coalesce(inside, F.lit(0)) + F.col("__ahead")).drop("__range", "__ahead")


def trailing(df: DataFrame, rank: str, rows: int, block: int, aggregates: dict) -> DataFrame:
    """Aggregates over the `rows` rows up to each, in the order of a global rank.

    Rows are cut into blocks of that many ranks; the last rows of a block are lent to the next one.
    """
    block = max(block, rows)
    at = ((F.col(rank) - 1) / block).cast("long")
    lent = ((F.col(rank) - 1) % block) >= block - (rows - 1)
    dealt = df.withColumn("__own", at).withColumn("__block", F.explode(F.when(lent, F.array(at, at + 1)).otherwise(F.array(at))))
    frame = Window.partitionBy("__block").orderBy(rank).rowsBetween(-(rows - 1), 0)
    done = dealt.select("*", *(a.over(frame).alias(n) for n, a in aggregates.items()))
    return done.where("__own = __block").drop("__own", "__block")
