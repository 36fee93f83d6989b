"""The provided `events` table read as a tape of book events.

Views add bids and signups add asks in price bands that never cross; the third later order of a side makes an order
expire; clicks execute and errors cancel a quarter of the latest order, once each; purchases are trades at the other side's
band. Original rows arrive at 2 * event_id, expiries just before the order that causes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tapeloom.schema import ADD, CANCEL, DELETE, EXECUTE, TRADE, canonical

MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))"
EXPIRES_AFTER = 3


def book_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def from_events(events: DataFrame) -> DataFrame:
    raw = events.select(
        F.col("event_id").alias("e"),
        (F.expr(MICROS) * 1000).alias("ns"),
        (F.col("user_id") % 5).alias("venue"),
        F.concat(F.lit("SYM"), (F.col("user_id") % 8).cast("string")).alias("symbol"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("qty"),
        (F.floor(F.col("value") * 100).cast("long") % 64).alias("o"),
        F.col("event_type").alias("what"),
    )
    book = Window.partitionBy("venue", "symbol").orderBy("e")
    same = Window.partitionBy("venue", "symbol", "what").orderBy("e")
    is_add = F.col("what").isin("view", "signup")
    side = F.when(F.col("what") == "view", 0).otherwise(1)
    raw = raw.withColumn("side", F.when(is_add, side)).withColumn("px", F.when(F.col("what") == "view", 9999 - F.col("o")).when(F.col("what") == "signup", 10001 + F.col("o")))
    latest = F.last(F.when(is_add, F.struct("e", "side", "px", "qty")), ignorenulls=True).over(book)
    raw = raw.withColumn("of", latest).withColumn("by", F.lead(F.struct("e", "ns"), EXPIRES_AFTER).over(same))
    # One pass fans each row out to the events it stands for.
    hit = Window.partitionBy("of.e", "what").orderBy("e")
    raw = raw.withColumn("nth", F.when(F.col("what").isin("click", "error"), F.row_number().over(hit)))
    row = lambda kind, at, ns, oid, side, px, qty: F.struct(F.lit(kind).alias("event_type"), at.alias("arrival"), ns.alias("ns"), oid.alias("order_id"), side.cast("int").alias("side"), px.cast("long").alias("price"), qty.cast("long").alias("qty"))
    e, ns = F.col("e"), F.col("ns")
    quarter = F.floor(F.col("of.qty") / 4)
    added = row(ADD, 2 * e, ns, e + 1, F.col("side"), F.col("px"), F.col("qty"))
    expired = row(DELETE, 2 * F.col("by.e") - 1, F.col("by.ns"), e + 1, F.col("side"), F.lit(0), F.lit(0))
    reduced = lambda kind: row(kind, 2 * e, ns, F.col("of.e") + 1, F.col("of.side"), F.lit(0), quarter)
    traded = row(TRADE, 2 * e, ns, F.lit(0).cast("long"), e % 2, F.when(e % 2 == 0, 10001).otherwise(9999), F.col("qty"))
    fan = (
        F.when(is_add & F.col("by").isNotNull(), F.array(added, expired))
        .when(is_add, F.array(added))
        .when((F.col("what") == "click") & F.col("of").isNotNull() & (F.col("nth") == 1) & (quarter > 0), F.array(reduced(EXECUTE)))
        .when((F.col("what") == "error") & F.col("of").isNotNull() & (F.col("nth") == 1) & (quarter > 0), F.array(reduced(CANCEL)))
        .when(F.col("what") == "purchase", F.array(traded))
    )
    flat = raw.select("venue", "symbol", F.explode(fan).alias("r")).select("venue", "symbol", "r.*")
    flat = flat.withColumn("sequence", F.row_number().over(Window.partitionBy("venue").orderBy("arrival")))
    return flat.select(*canonical(arrival="arrival", venue="venue", event_type="event_type", sequence="sequence", exchange_ts_ns="ns", ingest_ts_ns="ns", symbol="symbol", order_id="order_id", qty="qty", price="price", side="side", raw_type="event_type"))


#: The same tape for DuckDB, as the first entries of a WITH clause; the tape is `ev`.
TAPE_SQL = """
raw AS (SELECT event_id e, epoch_us(ts) * 1000 ns, user_id % 5 venue, 'SYM' || (user_id % 8) symbol, CAST(json_extract(props, '$.k') AS BIGINT) + 1 qty,
    CAST(floor(value * 100) AS BIGINT) % 64 o, event_type what FROM events),
adds AS (SELECT e, ns, venue, symbol, qty, CASE WHEN what = 'view' THEN 0 ELSE 1 END side, CASE WHEN what = 'view' THEN 9999 - o ELSE 10001 + o END px,
    lead(e, 3) OVER w by_e, lead(ns, 3) OVER w by_ns FROM raw WHERE what IN ('view', 'signup') WINDOW w AS (PARTITION BY venue, symbol, what ORDER BY e)),
seen AS (SELECT *, max(CASE WHEN what IN ('view', 'signup') THEN e END) OVER (PARTITION BY venue, symbol ORDER BY e) of_e FROM raw),
hits AS (SELECT s.e, s.ns, s.venue, s.symbol, s.what, a.e of_e, a.side, a.qty // 4 q, row_number() OVER (PARTITION BY a.e, s.what ORDER BY s.e) nth
    FROM seen s JOIN adds a ON a.e = s.of_e WHERE s.what IN ('click', 'error')),
flat AS (
    SELECT 2 * e arrival, venue, symbol, 0 event_type, ns, e + 1 order_id, side, px price, qty FROM adds
    UNION ALL SELECT 2 * by_e - 1, venue, symbol, 5, by_ns, e + 1, side, 0, 0 FROM adds WHERE by_e IS NOT NULL
    UNION ALL SELECT 2 * e, venue, symbol, CASE WHEN what = 'click' THEN 2 ELSE 4 END, ns, of_e + 1, side, 0, q FROM hits WHERE nth = 1 AND q > 0
    UNION ALL SELECT 2 * e, venue, symbol, 7, ns, 0, e % 2, CASE WHEN e % 2 = 0 THEN 10001 ELSE 9999 END, qty FROM raw WHERE what = 'purchase'),
ev AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY arrival) AS seq FROM flat)"""
