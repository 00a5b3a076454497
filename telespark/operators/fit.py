"""Curve fits for plots: least-squares line and smoothing spline.

Both reduce the rows to sufficient statistics with Spark aggregates (partial
aggregation, so any number of rows and any skew): the line is solved in SQL
expressions, the spline's banded system of bounded size in one small group a
series; both curves are expressions over the x values again.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telespark.functions.nulls import nan_to_null
from telespark.operators import ordered


# The per-series solver runs in Python workers: ship this module's code with
# the task instead of requiring the package to be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Fixed value: what a sequence of whole steps may fall short of its end.
STEP_TOLERANCE = 1e-10


def p_lin(df: DataFrame, response: str, term: str, by: Sequence[str] = (),
          step: float = 0.01) -> DataFrame:
    """OLS line of ``response ~ term`` evaluated on a grid from min to max of
    the term in steps of 0.01 (R: ``(min*100):(max*100)/100``), per group of
    ``by``.  Pairs with a missing value are left out of the fit."""
    y, x = F.col(response), F.col(term)
    inv = 1.0 / step
    stats = df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"),
        F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    n = F.floor(F.col("_hi") * inv - F.col("_lo") * inv + STEP_TOLERANCE).cast("long")
    g = stats.filter(F.col("_lo").isNotNull()).withColumn(
        "_k", F.explode(F.sequence(F.lit(0).cast("long"), n)))
    xs = (F.col("_lo") * inv + F.col("_k")) / inv
    return g.select(*by, xs.alias("x"), (F.col("_a") + F.col("_b") * xs).alias("y"))


# ---------------------------------------------------------------- smoothing spline

def spline_points(df: DataFrame, response: str, term: str, by: Sequence[str] = (), rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct x of each series with everything a cubic B-spline fit needs.

    Points: (_s, x, w, ybar, n, i, b0..b3) - count and mean response at x,
    the series' distinct x, the knot interval that x lies in, and the four
    basis functions that are not zero there, on x scaled to [0, 1].  Knots:
    (_s, i, a..f) - for each interval its two knots c, d and two to each side
    (the ends repeat).  Series with under 4 distinct x have none.  ``rows``:
    points of a chunk in which ranks are counted."""
    s = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    y, x = nan_to_null(response), nan_to_null(term)
    d = (df.select(s.alias("_s"), x.alias("x"), y.alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
         .groupBy("_s", "x").agg(F.count(F.lit(1)).cast("double").alias("w"), F.avg("y").alias("ybar")))
    # Ranks of a long table come from chunks that the data cut: no window holds a long series.
    d = ordered.ranked(d, "_s", "x", rows).withColumn("nk", n_knots(F.col("n")))
    d = d.withColumn("u", F.when(F.col("n") >= 4, (F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))))
    # Knot k stands at place 1 + floor(k (n - 1) / (nk - 1)), k = 0 .. nk - 1: the last one up to place r follows from r.
    d = d.withColumn("_at", F.when(F.col("n") >= 4, F.expr("(place * (nk - 1) - 1) div (n - 1)")))
    d = d.withColumn("_knot", F.expr("_at < nk AND 1 + (_at * (n - 1)) div (nk - 1) = place"))
    d = d.withColumn("i", F.least(F.col("_at"), F.col("nk") - 2).cast("int"))
    on = Window.partitionBy("_s").orderBy("u")
    first, last = (f("u").over(on.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for f in (F.first, F.last))
    kn = d.filter("_knot").select("_s", "u", "nk")
    kn = kn.select("_s", "nk", (F.row_number().over(on) - 1).cast("int").alias("i"),
                   F.coalesce(F.lag("u", 2).over(on), first).alias("a"), F.coalesce(F.lag("u", 1).over(on), first).alias("b"), F.col("u").alias("c"),
                   *(F.coalesce(F.lead("u", j).over(on), last).alias(n) for j, n in ((1, "d"), (2, "e"), (3, "f"))))
    knots = kn.filter(F.col("i") < F.col("nk") - 1)
    d = d.join(knots.drop("nk"), ["_s", "i"], "left")
    return _with_basis(d).select("_s", "x", "w", "ybar", "n", "nk", "i", "b0", "b1", "b2", "b3"), knots


def n_knots(n):
    """Number of knots for n distinct x: all of them up to 49, then slowly growing."""
    # The published rule of the smoothing-spline function.
    a = [math.log2(v) for v in (50, 100, 140, 200)]

    def between(lo: float, hi: float, start: int, width: int):
        return F.pow(F.lit(2.0), lo + (hi - lo) * (n - start) / width)

    v = (F.when(n < 50, n.cast("double")).when(n < 200, between(a[0], a[1], 50, 150)).when(n < 800, between(a[1], a[2], 200, 600))
         .when(n < 3200, between(a[2], a[3], 800, 2400)).otherwise(200 + F.pow((n - 3200).cast("double"), F.lit(0.2))))
    return F.floor(v).cast("int")


def _with_basis(d: DataFrame) -> DataFrame:
    """Add b0..b3 from u and the local knots (de Boor's recursion)."""
    u = F.col("u")
    left = {j: u - F.col(c) for j, c in ((1, "c"), (2, "b"), (3, "a"))}
    right = {j: F.col(c) - u for j, c in ((1, "d"), (2, "e"), (3, "f"))}
    b = [F.lit(1.0)]
    for j in (1, 2, 3):
        saved, out = F.lit(0.0), []
        for r in range(j):
            temp = b[r] / (right[r + 1] + left[j - r])
            out.append(saved + right[r + 1] * temp)
            saved = left[j - r] * temp
        names = [f"_b{j}{r}" for r in range(j + 1)]
        d = d.withColumns(dict(zip(names, [*out, saved])))
        b = [F.col(n) for n in names]
    return d.withColumns({f"b{r}": b[r] for r in range(4)})


def spline_stats(points: DataFrame) -> DataFrame:
    """(_s, col, d0..d3, rhs): the band of X'WX (d0 the diagonal) and X'Wy for
    each basis column of each series - a bounded table, whatever the rows."""
    w, b = F.col("w"), [F.col(f"b{r}") for r in range(4)]
    rows = [F.struct((F.col("i") + p).alias("col"), *((w * b[p] * b[p + q] if p + q < 4 else F.lit(0.0)).alias(f"d{q}") for q in range(4)), (w * F.col("ybar") * b[p]).alias("rhs"))
            for p in range(4)]
    d = points.filter(F.col("b0").isNotNull()).select("_s", F.explode(F.array(*rows)).alias("r"))
    return d.groupBy("_s", "r.col").agg(*(F.sum(f"r.{c}").alias(c) for c in ("d0", "d1", "d2", "d3", "rhs")))


def penalty(knots: np.ndarray) -> np.ndarray:
    """Integrals of products of second derivatives of the cubic B-splines on
    ``knots`` (ends repeated): second differences of the coefficients weigh
    hat functions, whose products have known integrals."""
    t = np.concatenate([[knots[0]] * 3, knots, [knots[-1]] * 3])
    c = np.eye(len(t) - 4)
    for k in (3, 2):
        tt = t[3 - k : len(t) - (3 - k)]
        width = (tt[k + 1 : len(tt) - 1] - tt[1 : len(tt) - 1 - k])[:, None]
        c = k * np.diff(c, axis=0) / width
    h = np.diff(knots)
    g = np.zeros((len(knots), len(knots)))
    at = np.arange(len(h))
    g[at, at] += h / 3
    g[at + 1, at + 1] += h / 3
    g[at, at + 1] = g[at + 1, at] = h / 6
    return c.T @ g @ c


def _coefficients(spar: float):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("col")
        m = len(pdf)
        xtwx = np.zeros((m, m))
        for q in range(4):
            v = pdf[f"d{q}"].to_numpy()[: m - q]
            xtwx[np.arange(m - q), np.arange(q, m)] = v
            xtwx[np.arange(q, m), np.arange(m - q)] = v
        om = penalty(np.array(pdf["knots"].iloc[0], float))
        lam = np.trace(xtwx) / np.trace(om) * 256.0 ** (3.0 * spar - 1.0)
        beta = np.linalg.solve(xtwx + lam * om, pdf["rhs"].to_numpy())
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "beta": [beta]})

    return solve


def p_supsmu(df: DataFrame, response: str, term: str, by: Sequence[str] = (),
             spar: float = 0.1) -> DataFrame:
    """Smoothing spline of ``response ~ term`` per group: (x, fitted y) at the
    distinct x values.  Rows with a missing value are left out; a series with
    fewer than 4 distinct x has no curve (null).

    A penalised cubic B-spline with ``lambda = r 256^(3 spar - 1)``, ``r`` the
    ratio of the traces.  The band of the normal equations is a Spark
    aggregate; each series' bounded system (about 200 columns at most) is
    solved in one small group, and the curve is an expression again."""
    points, knots = spline_points(df, response, term, by)
    ends = knots.groupBy("_s").agg(F.concat(F.array_sort(F.collect_list("c")), F.array(F.max("d"))).alias("knots"))
    sys_ = spline_stats(points).join(ends, "_s").withColumn("id", F.to_json("_s"))
    beta = sys_.drop("_s").groupBy("id").applyInPandas(_coefficients(spar), "id string, beta array<double>")
    d = points.withColumn("id", F.to_json("_s")).join(beta, "id", "left")
    y = sum((F.col(f"b{r}") * F.get("beta", F.col("i") + r) for r in range(1, 4)), F.col("b0") * F.get("beta", F.col("i")))
    return d.select(*[F.col(f"_s.{c}").alias(c) for c in by], "x", F.when(F.col("n") >= 4, y).alias("y"))
