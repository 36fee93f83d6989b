"""Raw-book frames of a crypto venue: JSON arrays of an id, a price and a signed amount.

Frames are parsed by Spark's JSON functions. Rows become adds, replaces and cancels by what is known of an order, which is the last row of
the same order since the last snapshot; the state of a channel that loses and regains its place is two window frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tapeloom.functions.ranks import last_before, running_sum
from tapeloom.schema import ADD, BUY, CANCEL, REPLACE, SELL, U32, UNKNOWN_SIDE, VENUES, canonical
from tapeloom.shared import stored

PRICE_UNITS, QTY_UNITS = 10_000, 1_000_000
CONTROL, HEARTBEAT, SNAPSHOT, UPDATE, BAD = "control", "heartbeat", "snapshot", "update", "malformed"


def parse_frames(frames: DataFrame) -> DataFrame:
    """(arrival, symbol, exchange_ts_ns, frame) with kind, channel, sequence (0 if there is none), event and rows (order_id, price, amount)."""
    f, body, event = F.col("frame"), F.col("__body"), F.col("__event")
    # Each path is read once: what is used more than once is a column of its own.
    rest = [c for c in frames.columns if c != "frame"]
    read = frames.select(*rest, F.get_json_object(f, "$[1]").alias("__body"), F.get_json_object(f, "$.event").alias("__event"), F.get_json_object(f, "$[0]").alias("__channel"), F.get_json_object(f, "$[2]").alias("__sequence"))
    read = read.select("*", F.from_json(body, "array<string>").alias("__one"), F.when(body.rlike(r"^\s*\[\s*\["), F.from_json(body, "array<array<string>>")).when(body.rlike(r"^\s*\[\s*\]"), F.array().cast("array<array<string>>")).alias("__many"))
    one, many = F.col("__one"), F.col("__many")
    kind = (
        F.when(event.isNotNull(), CONTROL)
        .when(body == "hb", HEARTBEAT)
        .when(body.rlike(r"^\s*\[\s*(\[|\])"), SNAPSHOT)
        .when(body.rlike(r"^\s*\[") & (F.size(one) == 3), UPDATE)
        .otherwise(BAD)
    )
    as_row = lambda r: F.struct(F.try_element_at(r, F.lit(1)).try_cast("long").alias("order_id"), F.try_element_at(r, F.lit(2)).try_cast("double").alias("price"), F.try_element_at(r, F.lit(3)).try_cast("double").alias("amount"))
    rows = F.when(kind == SNAPSHOT, F.transform(many, as_row)).when(kind == UPDATE, F.array(as_row(one)))
    parsed = read.select(
        *rest,
        kind.alias("kind"),
        F.col("__channel").try_cast("long").alias("channel"),
        F.coalesce(F.col("__sequence").try_cast("long"), F.lit(0).cast("long")).alias("frame_sequence"),
        event.alias("event"),
        rows.alias("rows"),
    )
    whole = F.coalesce(F.forall("rows", lambda r: r["order_id"].isNotNull() & r["price"].isNotNull() & r["amount"].isNotNull()), F.lit(True))
    return parsed.withColumn("kind", F.when(whole, F.col("kind")).otherwise(BAD))


def fixed_point(value: Column, units: int) -> Column:
    """Whole units, rounded half away from zero; null for what is not a number from 0 to 2**32 - 1."""
    scaled = F.floor(value * units + 0.5)
    return F.when(F.isnan(value) | (value < 0) | (value * units > U32), None).otherwise(scaled.cast("long"))


def _placed(parsed: DataFrame) -> DataFrame:
    """Snapshots and updates with epoch and whether the channel has lost its place by then.

    Epochs are counted and the last number before a frame is found by ranges of arrival, and an epoch is lost from its first gap on, so a
    channel of any length is many tasks.
    """
    rows = parsed.where(F.col("kind").isin(SNAPSHOT, UPDATE)).withColumn("__snapshot", (F.col("kind") == SNAPSHOT).cast("long"))
    rows = running_sum(stored(rows, "frames"), "arrival", "__snapshot", "epoch", by=["symbol"])  # stored, as each step reads its rows more than once
    numbered = F.when(F.col("frame_sequence") != 0, F.struct("epoch", F.col("frame_sequence").alias("number")))
    rows = last_before(stored(rows.withColumn("__numbered", numbered), "frames"), "arrival", "__numbered", "__last", by=["symbol"])
    last = F.when(F.col("__last.epoch") == F.col("epoch"), F.col("__last.number"))
    gap = (F.col("kind") == UPDATE) & (F.col("frame_sequence") != 0) & (F.col("frame_sequence") != F.coalesce(last, F.lit(-1)) + 1)
    rows = stored(rows.withColumn("gap", gap).drop("__snapshot", "__numbered", "__last"), "frames")
    first = rows.where("gap").groupBy(F.col("symbol").alias("__symbol"), F.col("epoch").alias("__epoch")).agg(F.min("arrival").alias("__from"))
    rows = rows.join(first, F.col("symbol").eqNullSafe(F.col("__symbol")) & (F.col("epoch") == F.col("__epoch")), "left")
    return rows.withColumn("lost", (F.col("epoch") == 0) | F.coalesce(F.col("arrival") >= F.col("__from"), F.lit(False))).drop("__symbol", "__epoch", "__from")


def synced(parsed: DataFrame) -> DataFrame:
    """The frames that a client in step would apply, with epoch, the number of the snapshot they follow.

    A snapshot starts an epoch; an update out of sequence ends it until the next one. A client asks for a new snapshot when it ends.
    """
    return _placed(parsed).where("NOT lost").drop("gap", "lost")


def sync_stats(parsed: DataFrame) -> DataFrame:
    """(symbol, snapshots, gaps, ignored, applied): updates in no epoch or behind a gap are ignored."""
    p = _placed(parsed)
    update, n = F.col("kind") == UPDATE, lambda c: F.count(F.when(c, 1))
    by_epoch = p.groupBy("symbol", "epoch").agg(n(F.col("kind") == SNAPSHOT).alias("snapshots"), F.max(F.col("lost") & (F.col("epoch") > 0)).cast("long").alias("gaps"), n(update & F.col("lost")).alias("behind"), n(update & ~F.col("lost")).alias("applied"))
    return by_epoch.groupBy("symbol").agg(F.sum("snapshots").alias("snapshots"), F.sum("gaps").alias("gaps"), (F.sum("behind") - F.sum("gaps")).alias("ignored"), F.sum("applied").alias("applied"))


def lower(frames: DataFrame) -> DataFrame:
    """Canonical events of synced frames, with status: ok, rejected (a number out of range) or skipped (removal of an unknown order)."""
    flat = frames.select("arrival", "symbol", "exchange_ts_ns", "frame_sequence", "epoch", F.posexplode("rows").alias("k", "r")).select("*", "r.*").drop("r")
    flat = flat.withColumn("at", F.struct("arrival", "k")).withColumn("px", fixed_point(F.col("price"), PRICE_UNITS)).withColumn("q", fixed_point(F.abs("amount"), QTY_UNITS))
    gone = F.col("price") == 0
    valid = gone | (F.col("px").isNotNull() & F.col("q").isNotNull())
    w = Window.partitionBy("symbol", "epoch", "order_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(valid, F.struct(gone.alias("gone"), "px", "q")), ignorenulls=True).over(w)
    flat = flat.withColumn("was", before).withColumn("live", F.coalesce(~F.col("was.gone"), F.lit(False)))
    status = F.when(~valid, "rejected").when(gone & ~F.col("live"), "skipped").otherwise("ok")
    kind = F.when(gone, CANCEL).when(F.col("live"), REPLACE).otherwise(ADD)
    side = F.when(F.col("amount") > 0, BUY).when(F.col("amount") < 0, SELL).otherwise(UNKNOWN_SIDE)
    zero = F.lit(0).cast("long")
    prev = lambda c: F.when((kind == REPLACE), F.col(f"was.{c}")).otherwise(zero)
    return flat.select(
        *canonical(
            arrival=F.col("arrival") * 65536 + F.col("k"), venue=F.lit(VENUES["BITFINEX"]), event_type=kind, sequence="frame_sequence", exchange_ts_ns="exchange_ts_ns", ingest_ts_ns="exchange_ts_ns", symbol=F.substring("symbol", 1, 8), order_id="order_id",
            reference_order_id=F.when(kind == REPLACE, F.col("order_id")).otherwise(zero), qty=F.when(gone, zero).otherwise(F.col("q")), price=F.when(gone, zero).otherwise(F.col("px")), prev_qty=prev("q"), prev_price=prev("px"), side=side,
            raw_type=F.when(gone, F.lit(ord("X"))).when(F.col("live"), F.lit(ord("R"))).otherwise(F.lit(ord("A"))),
        ),
        status.alias("status"),
    )


def events(frames: DataFrame) -> DataFrame:
    return lower(synced(parse_frames(frames))).where("status = 'ok'").drop("status")


def write_sidecar(snapshot: DataFrame, path: str) -> None:
    """Symbol, cut sequence and rows of snapshots as JSON."""
    snapshot.where(F.col("kind") == SNAPSHOT).select("symbol", F.col("frame_sequence").alias("cut_sequence"), "exchange_ts_ns", "rows").write.mode("overwrite").json(path)


def read_sidecar(spark, path: str) -> DataFrame:
    return spark.read.schema("symbol string, cut_sequence long, exchange_ts_ns long, rows array<struct<order_id:long,price:double,amount:double>>").json(path)
