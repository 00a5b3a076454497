"""Row-level scalar helpers (all built-in expressions, no UDFs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def if_else(test, yes, no) -> Column:
    """R ``ifelse``: a null test gives null (SQL ``ELSE`` would take ``no``)."""
    t = _c(test)
    return F.when(t.isNull(), F.lit(None)).when(t, yes).otherwise(no)


def null_to_zero(col) -> Column:
    """``ifelse(is.na(x), 0, x)``; NaN counts as NA, as in R."""
    c = _c(col)
    return F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(0.0))


def n_clip(col, a: float = 0.0, b: float = 1.0) -> Column:
    """Clamp to [a, b]; NA (null or NaN) stays NA."""
    x = _c(col)
    return (F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double"))
            .when(x <= F.lit(a), F.lit(float(a)))
            .when(x >= F.lit(b), F.lit(float(b)))
            .otherwise(x.cast("double")))


def t_color(col, levels: Sequence[float], colors: Sequence[str]) -> Column:
    """Colour of the smallest level >= x; none -> null; duplicate level -> first.

    One array expression for each row: a binary search is not needed for the
    lists that a palette has, and a table of levels is joined by the caller.
    """
    x = _c(col)
    lv = F.array(*[F.lit(float(v)) for v in levels])
    co = F.array(*[F.lit(c) for c in colors])
    best = F.array_min(F.filter(lv, lambda l: l >= x))
    pos = F.array_position(lv, best).cast("int")
    return F.when(best.isNotNull(), F.element_at(co, pos))


def concat_label(*cols) -> Column:
    """``paste(a, b, ...)``: space separated, NA printed as ``NA``.

    Whole numbers print without a decimal point (``1`` not ``1.0``); text
    columns print as they are.
    """
    return F.concat_ws(" ", *(F.coalesce(_r_text(_c(c)), F.lit("NA")) for c in cols))


def _r_text(c: Column) -> Column:
    text = c.cast("string")
    whole = F.regexp_replace(text, r"^(-?[0-9]+)\.0$", "$1")
    return F.when(F.typeof(c).isin("double", "float"), whole).otherwise(text)


def make_point(x, y, strict: bool = False) -> Column:
    """Planar point ``struct(x, y)``; null if a coordinate is missing.

    ``strict=True`` raises instead, as ``st_as_sf`` does on NA coordinates.
    """
    xc, yc = _c(x), _c(y)
    missing = xc.isNull() | yc.isNull()
    pt = F.struct(xc.cast("double").alias("x"), yc.cast("double").alias("y"))
    if strict:
        err = F.raise_error(F.lit("missing values in coordinates not allowed"))
        return F.when(missing, err.cast("struct<x:double,y:double>")).otherwise(pt)
    return F.when(~missing, pt)


def euclid_distance(x1, y1, x2, y2) -> Column:
    """Planar Euclidean distance; null if any coordinate is null."""
    dx = _c(x1) - _c(x2)
    dy = _c(y1) - _c(y2)
    return F.sqrt(dx * dx + dy * dy)
