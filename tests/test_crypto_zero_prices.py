"""A price of 0 removes an order, in the crypto queries and in their SQL alike; so do holes in the frames' numbers."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", ["crypto_lowering", "crypto_resync_events"])
def test_zero_prices_and_holes(spark, tmp_path, name):
    import __spark_entry__ as entry

    e = spark.range(3000).where("id < 1200 OR id >= 1300")
    events = e.select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).alias("user_id"), F.when(F.col("id") % 13 == 0, "error").otherwise("view").alias("event_type"),
        F.when(F.col("id") % 5 == 0, 0.0).when(F.col("id") % 101 == 0, 500000.0).otherwise(F.col("id") / 100).alias("value"), F.lit('{"k": 3}').alias("props"),
    )
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = Counter(tuple(dict(zip(names, r))[c] for c in got.columns) for r in found.fetchall())
    assert want and Counter(tuple(r) for r in got.collect()) == want
