"""Command line over written tables: python -m tapeloom.cli health|ticks|stream-nbbo|nbbo --events DIR --quotes DIR ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tapeloom.operators import service
from tapeloom.sources.sinks import read_events


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    p = argparse.ArgumentParser(prog="tapeloom")
    p.add_argument("request", choices=["health", "ticks", "stream-nbbo", "nbbo"])
    p.add_argument("--events", required=True, help="folder of write_events")
    p.add_argument("--quotes", required=True, help="Parquet of changes of the best bid and offer")
    p.add_argument("--symbol", default="")
    p.add_argument("--start", type=int, default=0)
    p.add_argument("--end", type=int, default=0)
    p.add_argument("--at", type=int, default=0)
    p.add_argument("--limit", type=int, default=0)
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("tapeloom").getOrCreate()
    events, quotes = read_events(spark, a.events), spark.read.parquet(a.quotes)
    if a.request == "health":
        rows = [service.health(events, quotes).first().asDict()]
    elif a.request == "nbbo":
        rows = [service.query_nbbo(quotes, a.symbol, a.at)]
    else:
        stream = service.stream_ticks if a.request == "ticks" else service.stream_nbbo
        rows = (r.asDict() for r in stream(events if a.request == "ticks" else quotes, a.symbol, a.start, a.end, a.limit).toLocalIterator())
    for r in rows:
        print(json.dumps(r, default=str), file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
