"""Aggregates and predicates with R's missing-value rules.

SQL aggregates skip nulls; R's ``sum``/``mean`` without ``na.rm`` return NA as
soon as one input is NA, and ``%in%`` is never NA.  These helpers build the R
behaviour from built-in expressions so they stay inside whole-stage codegen and
keep Spark's partial (map-side) aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def in_set(col, values: Iterable) -> Column:
    """``x %in% values``: true/false, never null (null input -> false)."""
    return F.coalesce(_c(col).isin(list(values)), F.lit(False))


def strict_sum(col) -> Column:
    """``sum(x)`` without ``na.rm``: null if any input is null."""
    c = _c(col)
    return F.when(F.max(c.isNull().cast("int")) == 1, F.lit(None)).otherwise(F.sum(c))


def count_if(cond) -> Column:
    """``sum(<logical>)`` without ``na.rm``: counts true, null if any test is null.

    R's ``&`` is three-valued like SQL's (``FALSE & NA`` is ``FALSE``), so the
    poison only fires for tests that really are unknown.
    """
    c = _c(cond)
    return F.when(F.max(c.isNull().cast("int")) == 1, F.lit(None).cast("long")) \
        .otherwise(F.sum(F.when(c, 1).otherwise(0)).cast("long"))


def strict_mean(col) -> Column:
    """``mean(x)`` without ``na.rm``: null if any input is null (or NaN kept)."""
    c = _c(col)
    return F.when(F.max(c.isNull().cast("int")) == 1, F.lit(None)).otherwise(F.avg(c))


def nan_to_null(col) -> Column:
    """NaN counts as missing, as in R."""
    return F.nanvl(_c(col).cast("double"), F.lit(None).cast("double"))


def mean_narm(col) -> Column:
    """``mean(x, na.rm=TRUE)``: NA and NaN removed.

    R returns NaN for an all-NA group; this returns null (documented choice).
    """
    return F.avg(nan_to_null(col))


def any_true(cond) -> Column:
    """True if any test is true.  Unknown tests are ignored; R would count them
    as a hit, which no Game row can show (its event is never missing)."""
    return F.coalesce(F.bool_or(_c(cond)), F.lit(False))


def exact_seconds_sum(col) -> Column:
    """Sum of durations in seconds that are whole microseconds (``Time_delta``).

    Accumulated as integer microseconds, so the result is exact and the same
    for every partitioning and task order; null if any input is null.
    """
    c = _c(col)
    micros = F.round(c * F.lit(1e6)).cast("long")
    return F.when(F.max(c.isNull().cast("int")) == 1, F.lit(None)) \
        .otherwise(F.sum(micros).cast("double") / F.lit(1e6))
