"""Is a value in a table of values?  An existence join behind a Bloom filter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telespark.session import written

#: Bits for each distinct value, positions of a value, and most bits of a filter (8 MB, broadcast).
BITS, HASHES, MOST_BITS = 12, 4, 1 << 26
#: Up to so many distinct values a join without a filter is as cheap: Spark broadcasts them by their size.
FEW = 10_000

#: Fixed value: bits of one bucket of Spark's bitmap functions.
BUCKET = 32768


def _positions(value: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(value, F.lit(seed)), F.lit(bits)) for seed in range(HASHES)]


def bloom_filter(values: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap) of a one-column table of distinct values, as an aggregate: at most bits / 32768 rows."""
    (name,) = values.columns
    at = values.select(F.explode(F.array(*_positions(F.col(name), bits))).alias("at"))
    return at.groupBy((F.col("at") / BUCKET).cast("int").alias("bucket")).agg(F.bitmap_construct_agg((F.col("at") % BUCKET)).alias("bitmap"))


def _bit(bitmaps: Column, position: Column) -> Column:
    """Bit of an array of bitmaps: byte position // 8 of its bucket's, from the lowest bit on."""
    inside = position % BUCKET
    byte = F.substring(F.get(bitmaps, (position / BUCKET).cast("int")), (inside / 8).cast("int") + 1, F.lit(1))
    return F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.call_function("shiftleft", F.lit(1), (inside % 8).cast("int"))) != 0


def flag(df: DataFrame, col: str, values: DataFrame, out: str) -> DataFrame:
    """``df`` with the boolean ``out``: the value of ``col`` is in the one-column table ``values``.

    Never null: missing values are in no table, and missing entries of the
    table match nothing.  Every row of ``df`` comes back once, however often a
    value is repeated in the table.  A large table is turned into a Bloom
    filter first: rows that it refuses are false where they stand and are not
    shuffled; the others are joined with the values, so the answer is exact.
    The filter has at most ``MOST_BITS`` bits; beyond the values that fill it,
    more rows go to the join and the result stays the same."""
    (name,) = values.columns
    known = written(values.select(F.col(name).alias("_value")).dropna().distinct(), "values")
    n = known.count()
    if n <= FEW:
        return _join(df, col, known, out)
    bits = min(MOST_BITS, -(-n * BITS // BUCKET) * BUCKET)
    by_bucket = bloom_filter(known, bits).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bitmap"))).alias("m"))
    bitmaps = by_bucket.select(F.transform(F.sequence(F.lit(0), F.lit(bits // BUCKET - 1)), lambda b: F.element_at("m", b))).scalar()
    maybe = _passes(F.col(col), bitmaps, bits)
    refused = df.where(~maybe).withColumn(out, F.lit(False))
    return refused.unionByName(_join(df.where(maybe), col, known, out))


def _passes(value: Column, bitmaps: Column, bits: int) -> Column:
    passes = value.isNotNull()
    for p in _positions(value, bits):
        passes = passes & F.coalesce(_bit(bitmaps, p), F.lit(False))
    return passes


def _join(df: DataFrame, col: str, known: DataFrame, out: str) -> DataFrame:
    return df.join(known, df[col] == known["_value"], "left").withColumn(out, F.col("_value").isNotNull()).drop("_value")


def false_positive_rate(n: int, bits: int) -> float:
    """Share of absent values that pass a filter of n values."""
    return (1 - math.exp(-HASHES * n / bits)) ** HASHES
