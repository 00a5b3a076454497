"""Timestamp parsing and arithmetic on TIMESTAMP_NTZ columns.

Log times carry no zone, so everything stays ``timestamp_ntz``.  Durations are
seconds as doubles computed from exact microsecond differences.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference's timestamp text format (date, time, optional
# fractional seconds) and the numeric literal shape accepted by as.numeric.
TIMESTAMP_PREFIX = r"^\s*[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}[ T][0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}([.][0-9]+)?"
NUMERIC_TEXT = r"^\s*[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][-+]?[0-9]+)?\s*$|^\s*[-+]?(Inf|NaN)\s*$"

UNIT_MICROS = {
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}

# Chunk id given to rows without a timestamp: larger than any real chunk, so
# those rows sort last, as R's arrange() puts NA last.
NULL_CHUNK = 9_223_372_036_854_775_807

EPOCH_TEXT = "1970-01-01 00:00:00"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_timestamp(col) -> Column:
    """``as.POSIXct(x, format="%Y-%m-%d %H:%M:%OS")``.

    Reads the leading date-time (with fraction) and ignores trailing text;
    malformed input gives null instead of an error.
    """
    text = F.regexp_extract(_c(col).cast("string"), TIMESTAMP_PREFIX, 0)
    text = F.regexp_replace(F.trim(text), "T", " ")
    return F.when(text != "", text).try_cast("timestamp_ntz")


def cast_numeric(col) -> Column:
    """``as.numeric(x)``: text -> double, anything malformed -> null.

    A regex guard keeps Spark-only literals such as ``1d`` or ``1f`` out.
    """
    s = _c(col).cast("string")
    text = F.regexp_replace(F.trim(s), r"^([-+]?)Inf$", "$1Infinity")
    return F.when(s.rlike(NUMERIC_TEXT), text).try_cast("double")


def cast_integer(col) -> Column:
    """``as.integer(x)`` of text: -> int, truncated toward zero, out of range -> null."""
    d = cast_numeric(col)
    return F.when(F.abs(d) < 2147483648.0, d.cast("int"))


def cast_integer_num(col) -> Column:
    """``as.integer(x)`` of a number (e.g. a duration in seconds)."""
    d = _c(col).cast("double")
    return F.when(F.abs(d) < 2147483648.0, d.cast("int"))


def trunc_unit(col, unit: str = "second") -> Column:
    """Drop the fraction below ``unit`` (``format(ts, "%Y-%m-%d %H:%M:%S")``).

    Exact arithmetic on wall-clock microseconds, independent of the session
    time zone."""
    c = _c(col)
    drop = F.pmod(epoch_micros(c), F.lit(UNIT_MICROS[unit]).cast("long"))
    return F.timestamp_add("MICROSECOND", -drop, c)


def epoch_micros(col) -> Column:
    """Microseconds since 1970-01-01 of a timestamp_ntz."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH_TEXT).cast("timestamp_ntz"), _c(col))


def unit_chunk(col, unit: str) -> Column:
    """Non-null, order-preserving bucket id of a timestamp (null -> last)."""
    return F.coalesce(
        F.floor(epoch_micros(col) / F.lit(UNIT_MICROS[unit])).cast("long"),
        F.lit(NULL_CHUNK).cast("long"))


def duration_seconds(start, end) -> Column:
    """``as.numeric(difftime(end, start, units="secs"))``, exact to the microsecond."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)).cast("double") / F.lit(1e6)


def add_seconds(ts, seconds) -> Column:
    """``seconds(n) + ts``."""
    return (_c(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                        _c(seconds).cast("decimal(18,6)"))).cast("timestamp_ntz")


def format_time(col) -> Column:
    """``format(ts, "%Y-%m-%d %H:%M:%S")``."""
    return F.date_format(_c(col), "yyyy-MM-dd HH:mm:ss")
