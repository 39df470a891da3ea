"""Column expressions for time buckets, shards and tags, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 64-bit FNV-1a hash: the start in two halves, and the low factor of the prime 2**40 + 435.
FNV_HIGH, FNV_LOW, FNV_FACTOR = 0xCBF29CE4, 0x84222325, 435
HALF = 0xFFFFFFFF


def window_start(timestamp_us: Column, width_us: Column | int) -> Column:
    """The start of the width's bucket that holds a time; floors below zero too, and overflow is an error."""
    return timestamp_us - F.pmod(timestamp_us, width_us if isinstance(width_us, Column) else F.lit(width_us))


def _utf8_chars(text: Column) -> Column:
    """A string's UTF-8 bytes as an array of characters of the same number."""
    read = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    return F.when(F.octet_length(text) == 0, F.array().cast("array<string>")).otherwise(read)


def utf8_values(text: Column) -> Column:
    """A string's UTF-8 bytes as an array of numbers."""
    return F.transform(_utf8_chars(text), lambda c: F.ascii(c).cast("bigint"))


def _length_prefixed(text: Column) -> Column:
    size = F.octet_length(text).cast("bigint")
    prefix = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i < 4, F.call_function("shiftright", size, i * 8).bitwiseAND(255)).otherwise(0).cast("bigint"))
    return F.concat(prefix, utf8_values(text))


def _low_half(text: Column, begin: Column) -> Column:
    """The hash's low half after a text and its length, whose four upper bytes are zero and only multiply."""
    size = F.octet_length(text).cast("bigint")

    def step(lo: Column, byte: Column) -> Column:
        return (lo.bitwiseXOR(byte) * FNV_FACTOR).bitwiseAND(F.lit(HALF))

    for i in range(4):
        begin = step(begin, F.call_function("shiftright", size, F.lit(i * 8)).bitwiseAND(F.lit(255).cast("bigint")))
    begin = (begin * (FNV_FACTOR**4 & HALF)).bitwiseAND(F.lit(HALF))
    return F.aggregate(_utf8_chars(text), begin, lambda lo, c: step(lo, F.ascii(c).cast("bigint")))


def shard_for(tenant: Column, series: Column, shards: Column | int) -> Column:
    """FNV-1a over length-prefixed tenant and series, unsigned modulo shards.

    Signed 64-bit products overflow under ANSI, so the state is two halves of 32 bits; for a power of two the low half is enough.
    """
    if isinstance(shards, int) and 0 < shards <= HALF + 1 and shards & (shards - 1) == 0:
        return _low_half(series, _low_half(tenant, F.lit(FNV_LOW).cast("bigint"))).bitwiseAND(F.lit(shards - 1).cast("bigint"))
    n = (shards if isinstance(shards, Column) else F.lit(shards)).cast("bigint")
    begin = F.struct(F.lit(FNV_HIGH).cast("bigint").alias("hi"), F.lit(FNV_LOW).cast("bigint").alias("lo"))

    def step(state: Column, byte: Column) -> Column:
        lo = state["lo"].bitwiseXOR(byte)
        product = lo * FNV_FACTOR
        carried = state["hi"] * FNV_FACTOR + F.shiftleft(lo, 8) + F.shiftright(product, 32)
        return F.struct(carried.bitwiseAND(F.lit(HALF)).alias("hi"), product.bitwiseAND(F.lit(HALF)).alias("lo"))

    def finish(state: Column) -> Column:
        return ((state["hi"] % n) * (F.lit(1 << 32).cast("bigint") % n) + state["lo"] % n) % n

    return F.aggregate(F.concat(_length_prefixed(tenant), _length_prefixed(series)), begin, step, finish)


def tags_json(tags: Column) -> Column:
    """Canonical JSON text of a string map: keys in order, an empty map for null."""
    entries = F.array_sort(F.map_entries(F.coalesce(tags, F.create_map().cast("map<string,string>"))))
    return F.to_json(F.map_from_entries(entries))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def time_order(timestamp: str = "timestamp_us", sequence: str = "sequence", ordinal: str = "ordinal") -> Column:
    """What first and last go by."""
    return F.struct(timestamp, sequence, ordinal)
