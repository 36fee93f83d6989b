import io
import json

import pytest
from pyspark.sql import functions as F

from tapeloom import cli
from tapeloom.functions import stats
from tapeloom.operators import book, features, nbbo, research, sequence
from tapeloom.plans import research as plans
from tapeloom.sources import decode, files, sinks
from tapeloom.sources.adapter import book_events
from tapeloom.streaming import stateful


@pytest.fixture()
def replay(spark, small, tmp_path):
    """The tape in four files in order of arrival, as a table and as a stream of one file a micro-batch."""
    ev = book_events(spark, small).persist()
    cut = [r[0] for r in ev.select(F.expr("explode(approx_percentile(arrival, array(0.25D, 0.5D, 0.75D)))")).collect()]
    lo = [None, *cut]
    for k, (a, b) in enumerate(zip(lo, [*cut, None])):
        part = ev.where((F.lit(a).isNull() | (F.col("arrival") > F.lit(a))) & (F.lit(b).isNull() | (F.col("arrival") <= F.lit(b))))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "tape"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "tape"))
    return ev, stream, str(tmp_path)


def drain(spark, df, tmp, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp}/{name}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_tops_stream_equals_batch(spark, replay):
    ev, stream, tmp = replay
    cols = ["arrival", "bid_price", "bid_qty", "ask_price", "ask_qty", "queue_ahead", "changed_top"]
    got, want = drain(spark, stateful.tops(stream), tmp, "tops").select(cols), book.with_tops(ev).select(cols)
    assert got.count() == ev.count() and got.exceptAll(want).count() == 0


def test_feature_stream_equals_batch(spark, replay):
    ev, stream, tmp = replay
    hour = 3_600_000_000_000
    cols = ["arrival", "bid_price", "ask_qty", *(F.round(c, 8).alias(c) for c in ("microprice", "ofi", "queue_ahead", "effective_spread", "kyle_lambda", "vpin"))]
    got = drain(spark, stateful.features(stream, hour, 500), tmp, "feats").select(*cols)
    want = features.features(nbbo.nbbo(ev), hour, 500).select(*cols)
    assert got.count() == want.count() > 100 and got.exceptAll(want).count() == 0


def test_sequence_stream_equals_batch(spark, replay):
    ev, stream, tmp = replay
    lossy = lambda d: d.where("sequence % 17 <> 0")
    got = drain(spark, stateful.sequenced(lossy(stream), 8), tmp, "seqs")
    want = sequence.sequenced(lossy(ev), 8).where("release IS NOT NULL").select("venue", "release", "arrival")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_arbitration_stream(spark, replay):
    ev, stream, tmp = replay
    twice = stream.unionByName(stream.withColumn("arrival", F.col("arrival") + 1))
    assert drain(spark, stateful.arbitrated(twice, "60 days"), tmp, "arb").count() == ev.count()


def test_journalled_stream(spark, replay):
    ev, stream, tmp = replay
    stateful.journalled(stream, [f"{tmp}/a", f"{tmp}/b"], f"{tmp}/cp").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp}/a").count() == spark.read.parquet(f"{tmp}/b").count() == ev.count()


def test_wire_events(spark, small):
    ev = book_events(spark, small).withColumn("exchange_ts_ns", F.col("exchange_ts_ns") % (1 << 47)).orderBy("arrival").limit(60)
    messages = [bytes(r["p"]) for r in ev.select("arrival", decode.itch_payload(F.col("event_type")).alias("p")).orderBy("arrival").collect()]
    grams = spark.createDataFrame([(k, 9, bytearray(g)) for k, g in enumerate(files.pack_mold(messages))], "arrival long, ingest_ts_ns long, payload binary")
    got = [r["order_id"] for r in stateful.wire_events(grams, "itch").orderBy("sequence").collect()]
    assert got == [r["order_id"] for r in ev.orderBy("arrival").collect()]


def test_event_tables_and_cli(spark, small, tmp_path):
    ev = book_events(spark, small)
    sinks.write_events(ev, str(tmp_path / "ev"), append=False)
    back = sinks.read_events(spark, str(tmp_path / "ev"))
    assert back.select(ev.columns).exceptAll(ev).count() == 0 and back.count() == ev.count()
    plan = back.where("symbol = 'SYM1' AND venue = 2")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(symbol), EqualTo(symbol,SYM1)]" in plan and "PartitionFilters: [isnotnull(venue" in plan
    quotes = nbbo.changes(nbbo.nbbo(ev))
    quotes.write.parquet(str(tmp_path / "q"))
    where = ["--events", str(tmp_path / "ev"), "--quotes", str(tmp_path / "q")]
    for args, n in ((["health"], 1), (["ticks", "--symbol", "SYM1", "--limit", "4"], 4), (["nbbo", "--symbol", "SYM1", "--at", str(1 << 62)], 1), (["stream-nbbo", "--limit", "3"], 3)):
        out = io.StringIO()
        cli.main([*args, *where], spark, out)
        rows = [json.loads(x) for x in out.getvalue().splitlines()]
        assert len(rows) == n
    assert sinks.published(ev).columns == list(sinks.PUBLISHED)


def test_exports(spark, small, tmp_path):
    rows = plans._rows(spark, small)
    labelled = research.labelled_features(rows, plans.HORIZONS).select("arrival", "symbol", "mid", "microprice", "labels")
    sinks.export_features(labelled, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["arrival", "symbol", "mid", "microprice", "label_0", "label_1", "label_2"]
    a = {r["arrival"]: (r["microprice"], r["labels"][2]) for r in labelled.collect()}
    assert all((float(r["microprice"]), float(r["label_2"]) if r["label_2"] else None) == a[int(r["arrival"])] for r in back.collect())
    pairs = plans._pairs(spark, small)
    metrics = research.fold_metrics(pairs)
    for _ in range(2):
        sinks.register_trials(metrics, str(tmp_path / "trials"))
    assert sinks.trial_count(spark, str(tmp_path / "trials")) == metrics.count()
    survival = [{"signal": "ofi", "horizon": 1} | {k: v for k, v in stats.deflated_sharpe(0.4, 0, 3, 100, 75, 0.05).items() if k in ("adjusted", "p_value")}]
    tested = research.test_folds(rows)
    sinks.tearsheet(str(tmp_path / "sheet"), research.aggregate_metrics(metrics), survival, research.capacity_sweep(plans._costed(spark, small)), research.fold_windows(tested), research.ablation(pairs.where(F.col("horizon") == plans.HORIZONS[0]), "ofi"))
    names = sorted(p.name for p in (tmp_path / "sheet").iterdir())
    assert names == ["ablation.md", "capacity.csv", "folds.json", "survival.csv", "tearsheet.json", "tearsheet.md"]
    assert (tmp_path / "sheet" / "survival.csv").read_text().splitlines()[1].startswith("ofi,1,") and len(json.loads((tmp_path / "sheet" / "folds.json").read_text())) == 5
    assert json.loads(sinks.report_json(spark.range(1).select(F.struct(F.lit(1).alias("b")).alias("a")))) == {"a": {"b": 1}}
