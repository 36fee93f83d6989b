"""Ordered walks: what is sequential by key, with memory bounded by its state.

A walker takes the rows of one key in order, batch by batch, and keeps only what later rows need. Spark deals rows by key
and sorts them (spilling where it must); a walker's batches are Arrow's, whatever the key's number of rows.

With `range_rows`, rows are cut into ranges of (keys, order) of about that many rows, and each range is a task of its own: the first ranges
of all keys are walked together, then the second ones, and so on. A range's walker begins with the state that the range before it left, and
results and states are written to the shared folder after each round. A lost executor costs a range, and no task is larger than one.
The setting tapeloom.walk.rangeRows gives it for all walks of a session.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tapeloom.shared import fresh_path, stored

SETTING = "tapeloom.walk.rangeRows"
_NTH, _STATE, _PART, _LAST = "__nth", "__state", "__part", "__last"


class Walker:
    """Rows of one key in order. It is pickled where a range ends, so it holds plain data."""

    def feed(self, rows: pa.RecordBatch) -> pa.RecordBatch | None:
        """Result rows that are known by now."""
        raise NotImplementedError

    def end(self) -> pa.RecordBatch | None:
        """Result rows that are left when the key's last row was seen."""


def pieces(batch: pa.RecordBatch, keys: list[str]):
    """Slices of consecutive rows with equal keys; a null equals a null."""
    n = batch.num_rows
    if n < 2:
        if n:
            yield batch
        return
    cut = None
    for k in keys:
        c = batch.column(k)
        a, b = c.slice(1), c.slice(0, n - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False) if not c.null_count else pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        cut = differs if cut is None else pc.or_(cut, differs)
    bounds = [0, *(i + 1 for i in pc.indices_nonzero(cut).to_pylist()), n]
    for lo, hi in zip(bounds, bounds[1:]):
        yield batch.slice(lo, hi - lo)


def _key(batch: pa.RecordBatch, keys: list[str]) -> tuple:
    return tuple(batch.column(k)[0].as_py() for k in keys)


def _through(keys: list[str], make: Callable[[], Walker]):
    def run(batches):
        now, walker = None, None
        for batch in batches:
            for rows in pieces(batch.drop_columns([_NTH]), keys):
                key = _key(rows, keys)
                if walker is None or key != now:
                    if walker is not None and (out := walker.end()) is not None:
                        yield out
                    now, walker = key, make()
                if (out := walker.feed(rows)) is not None:
                    yield out
        if walker is not None and (out := walker.end()) is not None:
            yield out

    return run


def walk(rows: DataFrame, keys: list[str], order: list[str], make: Callable[[], Walker], schema: str, range_rows: int | None = None) -> DataFrame:
    """Result rows (schema) of a walker for each key over its rows in order."""
    most = range_rows or int(rows.sparkSession.conf.get(SETTING, "0"))
    if most:
        return _in_ranges(rows, keys, order, make, schema, most)
    # A window deals rows by key only where they are not dealt so already; the sort above it is left out where it changes nothing.
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(_NTH, nth).sortWithinPartitions(*keys, *order).mapInArrow(_through(keys, make), schema)


# -- ranges -------------------------------------------------------------------------------------------------------
def _same(a: DataFrame, b: DataFrame, columns: list[str]):
    condition = None
    for c in columns:
        one = a[c].eqNullSafe(b[c])
        condition = one if condition is None else condition & one
    return condition


def _one_range(keys: list[str], make: Callable[[], Walker], out_schema: pa.Schema, key_types: list[pa.DataType]):
    """A state row comes before its key's rows; a key whose last range this is ends, any other leaves a state row."""
    names = [*out_schema.names, *(f"__key_{k}" for k in keys), _STATE]
    types = [*out_schema.types, *key_types, pa.binary()]

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        rest = [pa.nulls(batch.num_rows, t) for t in types[len(out_schema) :]]
        return pa.RecordBatch.from_arrays([*(batch.column(n).cast(t) for n, t in zip(out_schema.names, out_schema.types)), *rest], names)

    def left(key: tuple, walker: Walker) -> pa.RecordBatch:
        cells = [*(pa.nulls(1, t) for t in out_schema.types), *(pa.array([v], t) for v, t in zip(key, key_types)), pa.array([cloudpickle.dumps(walker)], pa.binary())]
        return pa.RecordBatch.from_arrays(cells, names)

    def run(batches):
        now, walker, last = None, None, False

        def closed():
            if walker is None:
                return
            out = walker.end() if last else None
            if out is not None:
                yield found(out)
            if not last:
                yield left(now, walker)

        for batch in batches:
            for rows in pieces(batch, keys):
                key = _key(rows, keys)
                if walker is None or key != now:
                    yield from closed()
                    now, walker, last = key, make(), False
                state = rows.column(_STATE)
                if state.null_count < rows.num_rows:  # at most one, the first
                    walker, rows = pickle.loads(state[0].as_py()), rows.slice(1)
                if rows.num_rows:
                    last = rows.column(_LAST)[0].as_py()
                    if (out := walker.feed(rows.drop_columns([_STATE, _LAST]))) is not None:
                        yield found(out)
        yield from closed()

    return run


def _in_ranges(rows: DataFrame, keys: list[str], order: list[str], make: Callable[[], Walker], schema: str, most: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    spark: SparkSession = rows.sparkSession
    rows = stored(rows, "walk-rows")
    parts = max(1, -(-rows.count() // most))
    cut = rows.repartitionByRange(parts, *(F.col(c) for c in [*keys, *order])).sortWithinPartitions(*keys, *order)
    cut = stored(cut.withColumn(_PART, F.spark_partition_id()), "walk-ranges")
    by = Window.partitionBy(*keys).orderBy(_PART)  # a row a key and range
    spans = cut.groupBy(*keys, _PART).agg(F.count("*").alias("__n"))
    spans = stored(spans.withColumn("__round", F.row_number().over(by)).withColumn(_LAST, F.lead(_PART).over(by).isNull()), "walk-spans")
    rounds = spans.agg(F.max("__round")).first()[0] or 0  # a number
    placed = cut.join(spans, _same(cut, spans, [*keys, _PART])).select(*(cut[c] for c in rows.columns), "__round", _LAST)
    placed.write.partitionBy("__round").parquet(dealt := fresh_path(spark, "walk-rounds"))
    whole = spark.read.schema(placed.schema).parquet(dealt)
    result = spark.createDataFrame([], schema)
    out_schema = to_arrow_schema(result.schema)
    key_types = to_arrow_schema(rows.select(*keys).schema).types
    kinds = dict(rows.dtypes)
    wide = ", ".join([schema, *(f"__key_{k} {kinds[k]}" for k in keys), f"{_STATE} binary"])
    path, states = fresh_path(spark, "walk-results"), None
    spark.createDataFrame([], wide).write.parquet(f"{path}/round=0")
    for number in range(1, rounds + 1):
        here = whole.where(F.col("__round") == number).drop("__round").withColumn(_STATE, F.lit(None).cast("binary"))
        if states is not None:
            begun = states.select(*(F.col(f"__key_{k}").alias(k) for k in keys), _STATE)
            here = here.unionByName(begun, allowMissingColumns=True)
        sorted_ = here.repartition(*keys).sortWithinPartitions(*keys, F.col(_STATE).isNull(), *order)
        sorted_.mapInArrow(_one_range(keys, make, out_schema, key_types), wide).write.parquet(f"{path}/round={number}")
        states = spark.read.schema(wide).parquet(f"{path}/round={number}").where(F.col(_STATE).isNotNull())
    found = spark.read.schema(wide).option("recursiveFileLookup", "true").parquet(path)
    return found.where(F.col(_STATE).isNull()).select(*result.columns)
