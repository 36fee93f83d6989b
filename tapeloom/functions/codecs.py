"""Scalar codecs as column expressions: symbols as numbers, base-36 keys, ticks, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom.schema import U32


def symbol_to_u64(symbol: Column) -> Column:
    """Eight ASCII bytes, padded with spaces, as a big-endian number; ASCII keeps it positive."""
    return F.conv(F.hex(F.rpad(symbol, 8, " ").cast("binary")), 16, 10).cast("long")


def u64_to_symbol(number: Column) -> Column:
    """The trimmed symbol; trailing NULs count as padding as well."""
    raw = F.decode(F.unhex(F.lpad(F.hex(number), 16, "0")), "ISO-8859-1")
    return F.rtrim(F.translate(raw, "\x00", " "))


def base36(text: Column) -> Column:
    """0 for anything but digits and capitals."""
    return F.when(text.rlike("^[0-9A-Z]+$"), F.conv(text, 36, 10).cast("long")).otherwise(0)


def rescale(ticks: Column, from_digits: int, to_digits: int = 4) -> Column:
    """Whole ticks of one scale to another, rounded down, at most 32 bits."""
    out = F.floor(ticks / 10 ** (from_digits - to_digits)) if from_digits > to_digits else ticks * 10 ** (to_digits - from_digits)
    return F.least(out.cast("long"), F.lit(U32))


def display_price(ticks: Column) -> Column:
    return (ticks / F.lit(10_000)).cast("decimal(18,4)")


def row_crc32(*columns: Column) -> Column:
    """CRC-32 of the columns' text forms, joined by a separator that no number holds."""
    return F.crc32(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns)).cast("binary"))


def sharded(events: DataFrame, shards: int) -> DataFrame:
    """Rows of a symbol together, in `shards` partitions. Which partition is not part of any result."""
    return events.repartition(shards, "symbol")


def shard_witness(events: DataFrame, shards: int) -> DataFrame:
    """Order-free checksum of a tape after sharding: equal for any number of shards."""
    cells = [F.col(c) for c in ("venue", "event_type", "sequence", "exchange_ts_ns", "symbol", "order_id", "qty", "price")]
    return sharded(events, shards).agg(F.bit_xor(F.xxhash64(*cells)).alias("witness"), F.count("*").alias("events"))
