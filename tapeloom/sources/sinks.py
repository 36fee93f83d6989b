"""Writers: tables for replay, feature and trial exports, reports."""

from __future__ import annotations

import json

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

DAY_NS = 86_400_000_000_000
#: What a published event carries.
PUBLISHED = ("venue", "event_type", "sequence", "exchange_ts_ns", "ingest_ts_ns", "symbol", "order_id", "reference_order_id", "qty", "price", "side", "raw_type")


def write_events(events: DataFrame, path: str, append: bool = True) -> None:
    """Parquet by day and venue; files hold ranges of symbols, sorted by symbol and time, so that symbol and time filters skip row groups."""
    dated = events.withColumn("day", F.floor(F.col("exchange_ts_ns") / DAY_NS).cast("int"))
    dealt = dated.repartitionByRange("day", "venue", "symbol").sortWithinPartitions("day", "venue", "symbol", "exchange_ts_ns", "arrival")
    dealt.write.partitionBy("day", "venue").mode("append" if append else "overwrite").parquet(path)


def read_events(spark, path: str) -> DataFrame:
    df = spark.read.parquet(path).drop("day")
    return df.withColumn("venue", F.col("venue").cast("short"))


def tee(events: DataFrame, path: str, cached: bool = True) -> DataFrame:
    """Writes events and gives them on; cached, they are computed once for both."""
    events = events.persist() if cached else events
    write_events(events, path)
    return events


def published(events: DataFrame) -> DataFrame:
    return events.select(*PUBLISHED)


def feature_columns(labelled: DataFrame, horizons: int) -> DataFrame:
    """Labelled features with a text column for each double and each horizon's label."""
    doubles = [f.name for f in labelled.schema if f.dataType.simpleString() == "double"]
    plain = [c for c in labelled.columns if c != "labels"]
    cells = [F.when(F.isnan(c), None).otherwise(F.col(c).cast("string")).alias(c) if c in doubles else F.col(c) for c in plain]
    labels = [F.when(F.isnan(F.col("labels")[k]), None).otherwise(F.col("labels")[k].cast("string")).alias(f"label_{k}") for k in range(horizons)]
    return labelled.select(*cells, *labels)


def export_features(labelled: DataFrame, path: str, horizons: int = 3) -> None:
    """CSV with a header: doubles in the shortest form that reads back, missing ones as empty cells, a column a horizon."""
    feature_columns(labelled, horizons).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def register_trials(metrics: DataFrame, path: str) -> None:
    """A JSON line a signal, horizon and fold, appended."""
    metrics.write.mode("append").json(path)


def trial_count(spark, path: str) -> int:
    return spark.read.json(path).select("signal", "horizon", "fold").distinct().count()


def report_json(report: DataFrame) -> str:
    """The one row of a report as nested JSON."""
    return report.select(F.to_json(F.struct("*")).alias("j")).first()["j"]


def _put(fs, path: str, text: str) -> None:
    with fs.open_output_stream(path) as out:
        out.write(text.encode())


def _table(rows: list[dict], columns: list[str]) -> str:
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows]) + "\n"


def _csv(rows: list[dict], columns: list[str]) -> str:
    return "\n".join([",".join(columns)] + [",".join("" if r[c] is None else str(r[c]) for c in columns) for r in rows]) + "\n"


def tearsheet(path: str, aggregates: DataFrame, survival: list[dict], capacity: DataFrame, folds: DataFrame, ablation: DataFrame, top: int = 10) -> None:
    """Report files of a study: tearsheet.md and .json with the best signals, survival.csv (survived where p < 0.05), capacity.csv, folds.json and ablation.md.

    All inputs are aggregates: signals, grid points and folds, never rows of data.
    """
    fs, base = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    fs.create_dir(base, recursive=True)
    best = [r.asDict() for r in aggregates.orderBy(F.desc("mean_ic"), "signal", "horizon").limit(top).collect()]
    columns = ["signal", "horizon", "mean_ic", "std_ic", "mean_spread", "std_spread", "folds"]
    _put(fs, f"{base}/tearsheet.md", f"# Signals by mean information coefficient\n\n{_table(best, columns)}")
    _put(fs, f"{base}/tearsheet.json", json.dumps({"top_signals": best, "survival": survival}, indent=1, default=str))
    marked = [s | {"survived": s["p_value"] < 0.05} for s in survival]
    _put(fs, f"{base}/survival.csv", _csv(marked, ["signal", "horizon", "adjusted", "p_value", "survived"]))
    curve = [r.asDict() for r in capacity.orderBy("participation").collect()]
    _put(fs, f"{base}/capacity.csv", _csv(curve, ["participation", "gross_sharpe", "net_sharpe", "mean_return"]))
    _put(fs, f"{base}/folds.json", json.dumps([r.asDict() for r in folds.orderBy("fold").collect()], indent=1))
    _put(fs, f"{base}/ablation.md", _table([r.asDict() for r in ablation.orderBy("variant").collect()], ["variant", "mean_ic", "mean_spread", "net_sharpe"]))
