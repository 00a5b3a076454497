"""Mixed models with two crossed random intercepts that may both have many levels.

``response ~ fixed + (1|first) + (1|second)`` by maximum likelihood, where no
level is a column and no matrix of levels exists.  The rows are reduced to the
*pair table*: the count and the column sums of every co-occurring pair of
levels.  With the first factor's scale t fixed, its intercepts are eliminated
level by level (weights w_g = t^2 / (1 + t^2 n_g)), which leaves for the second
factor, of scale s,

    deviance = sum log(1 + t^2 n_g) + log det(I + s^2 K) + n (1 + log(2 pi r^2 / n)),
    K = diag(n_h) - N' W N,

N being the counts of the pairs.  A product with K is two joins of a column of
the second factor's levels with the pair table.  Lanczos steps with K from a
start vector give a small tridiagonal matrix, and that gives products with
``(I + s^2 K)^-1`` and ``log(I + s^2 K)`` for *every* s at once: one run for all
column products and for the random probes of the log determinant serves the
whole profile of s.  Where the first factor has few levels, a level of the
second holds its row of N and its vectors, and only sums over the first
factor's levels leave a task: a step joins and shuffles no level.  Steps go on until the profile stands still.  The driver
holds the tridiagonal coefficients, one row a step.

Probes are fixed pseudo-random signs, so the estimate is the same on every run
and smooth in both scales; with no more levels than probes the log determinant
is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telespark.functions.nulls import nan_to_null
from telespark.operators.mixed import INTERCEPT, Fit, category_levels
from telespark.session import written

#: Scales of the second factor at which a profile is computed, before it is refined around its best point.
SCALES = np.array([0.0, *np.geomspace(1e-3, 1e2, 31)])
#: First grid of the first factor's scale, points of a finer grid, and how many follow.
COARSE, FINE, GRIDS = (0.0, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0), 5, 3
#: Vectors that one run of Lanczos steps carries as columns.
WIDTH = 48
#: With at most so many levels of the first factor, a step's products run inside the rows of the second's levels.
FEW_LEVELS = 1000
#: Counts of a dense piece of N inside a task.
PIECE = 1 << 20


@dataclass
class Profile:
    """What is known at one scale of the first factor: log determinant and column products of the first factor, the
    lengths that the start vectors' columns were divided by, and for each start vector its squared length and the tridiagonal coefficients of its steps."""

    logdet: float
    cross: np.ndarray
    unit: np.ndarray
    length: np.ndarray
    alpha: np.ndarray
    beta: np.ndarray

    @cached_property
    def spectra(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Weights and values of the tridiagonal matrix of each start vector that is not zero."""
        out = []
        for k in range(len(self.length)):
            if self.length[k] == 0:
                out.append((np.zeros(1), np.zeros(1)))
                continue
            off = self.beta[:, k]
            j = int(np.argmax(off == 0)) + 1 if (off == 0).any() else len(off)
            value, vector = np.linalg.eigh(np.diag(self.alpha[:j, k]) + np.diag(off[: j - 1], 1) + np.diag(off[: j - 1], -1))
            out.append((vector[0] ** 2, np.maximum(value, 0.0)))
        return out


def _step_length(alpha: np.ndarray, square: np.ndarray) -> np.ndarray:
    beta = np.sqrt(np.maximum(square - alpha * alpha, 0.0))
    beta[beta <= 1e-7 * np.sqrt(square)] = 0.0  # the space of this vector is exhausted
    return beta


# ------------------------------------------------------------------ steps with few levels of the first factor

_ROW = "nh double, at array<int>, n array<double>, q array<double>, w array<double>"


def _pieces(batches: Iterator[pa.RecordBatch], levels: int, width: int):
    """(batch, nh, N, q, w): some of the second factor's levels with their dense rows of N and their vectors."""
    rows = max(1, PIECE // levels)
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            b = batch.slice(start, rows)
            at = b.column("at")
            counts = np.zeros((b.num_rows, levels))
            counts[np.repeat(np.arange(b.num_rows), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = b.column("n").flatten().to_numpy()
            q, w = (b.column(c).flatten().to_numpy().reshape(-1, width) for c in "qw")
            yield b, b.column("nh").to_numpy(), counts, q, w


def _next_vectors(levels: int, width: int, alpha: np.ndarray, scale: np.ndarray, beta: np.ndarray, first: np.ndarray):
    """Task of one step: q' = scale * (w - alpha q), w' = K q' - beta q, the first factor's part of K q' being N first."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, nh, counts, q, w in _pieces(batches, levels, width):
            now = (w - alpha * q) * scale
            w = nh[:, None] * now - counts @ first - beta * q
            ends = pa.array(np.arange(0, now.size + 1, width), pa.int32())
            vectors = (pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1))) for x in (now, w))
            yield pa.RecordBatch.from_arrays([b.column("nh"), b.column("at"), b.column("n"), *vectors], ["nh", "at", "n", "q", "w"])
    return task


def _sums(levels: int, width: int):
    """Task that sums, over its levels of the second factor, q * w, w * w and N' w: a row for each number."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2 + levels, width))
        for _, _, counts, q, w in _pieces(batches, levels, width):
            out[0] += (q * w).sum(axis=0)
            out[1] += (w * w).sum(axis=0)
            out[2:] += counts.T @ w
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(out.size), pa.int32()), "x": pa.array(out.reshape(-1))})
    return task


class CrossedData:
    """Statistics of the complete rows; fixed terms are numeric, or text with few levels."""

    def __init__(self, df: DataFrame, response: str, fixed: Sequence[str], first: str, second: str, probes: int = 16):
        types = dict(df.dtypes)
        used = list(dict.fromkeys([response, *fixed, first, second]))
        d = written(df.select(*(nan_to_null(c).alias(c) if types[c] in ("double", "float") else F.col(c) for c in used)).dropna(), "crossed-rows")
        levels = category_levels(d, [t for t in fixed if types[t] == "string"])
        values: dict[str, Column] = {}
        for t in fixed:
            values.update({f"{t}{lv}": (F.col(t) == lv).cast("double") for lv in levels[t][1:]} if t in levels else {t: F.col(t).cast("double")})
        values["y"] = F.col(response).cast("double")
        self.columns = [INTERCEPT, *values]
        centre = d.agg(F.count("*").alias("n"), *(F.avg(v).alias(f"v{i}") for i, v in enumerate(values.values()))).first()
        self.n = centre["n"]
        # Centred columns: the intercept takes the difference, and products keep their digits.
        self.centre = [0.0] + [float(x or 0.0) for x in centre[1:]]
        cols = [F.lit(1.0)] + [v - c for v, c in zip(values.values(), self.centre[1:])]
        m = self.m = len(cols)
        rows = d.select(F.col(first).cast("string").alias("g"), F.col(second).cast("string").alias("h"), *(c.alias(f"v{i}") for i, c in enumerate(cols)))
        v = [F.col(f"v{i}") for i in range(m)]
        gram = rows.agg(*(F.sum(v[i] * v[j]) for i in range(m) for j in range(i, m))).first()
        self.gram = self._symmetric([x or 0.0 for x in gram])
        pairs = rows.groupBy("g", "h").agg(F.count("*").alias("n"), *(F.sum(x).alias(f"v{i}") for i, x in enumerate(v)))
        pairs = written(pairs, "pairs")
        sums = [F.sum(f"v{i}").alias(f"a{i}") for i in range(m)]
        self.first = written(pairs.groupBy("g").agg(F.sum("n").alias("ng"), *sums), "first-levels")
        self.second = written(pairs.groupBy("h").agg(F.sum("n").alias("nh"), *sums), "second-levels")
        self.pairs = written(pairs.select("g", "h", "n").join(self.first.select("g", "ng"), "g"), "level-pairs")
        self.levels = self.second.count()
        self.few = self.first.count() <= FEW_LEVELS
        self.exact = self.levels <= probes
        self.probes = self.levels if self.exact else probes
        self._known: dict[float, Profile] = {}

    def _symmetric(self, upper: Sequence[float]) -> np.ndarray:
        out = np.zeros((self.m, self.m))
        out[np.triu_indices(self.m)] = upper
        return out + np.triu(out, 1).T

    def _of_first(self, scales: Sequence[float]) -> dict[float, tuple[float, np.ndarray]]:
        """Log determinant of the first factor, and the column products corrected for it."""
        t2 = F.col("t") * F.col("t")
        w = t2 / (1 + t2 * F.col("ng"))
        a = [F.col(f"a{i}") for i in range(self.m)]
        d = self.first.withColumn("t", F.explode(F.array(*(F.lit(float(t)) for t in scales)))).groupBy("t").agg(
            F.sum(F.log1p(t2 * F.col("ng"))), *(F.sum(w * a[i] * a[j]) for i in range(self.m) for j in range(i, self.m)))
        return {r[0]: (r[1], self.gram - self._symmetric(r[2:])) for r in d.collect()}

    def profiles(self, scales: Sequence[float], steps: int = 60, tolerance: float = 1e-7) -> None:
        """Lanczos runs at the given scales of the first factor."""
        new = [t for t in dict.fromkeys(map(float, scales)) if t not in self._known]
        per = self.m * (self.m + 1) // 2 + self.probes
        at_once = max(1, WIDTH // per)
        of_first = self._of_first(new) if new and self.n else {}
        for i in range(0, len(new), at_once):
            self._run(new[i : i + at_once], of_first, steps, tolerance)

    def _starts(self, scales: Sequence[float]) -> tuple[DataFrame, np.ndarray, int]:
        """(h, nh, c0..): for each scale the second factor's sums of the columns corrected for the first factor, each
        alone and each two added (products follow from squares), and the probes."""
        t2 = [t * t for t in scales]
        corrected = self.pairs.join(self.first.drop("ng"), "g").groupBy("h").agg(
            *(F.sum(F.col("n") * (t / (1 + t * F.col("ng"))) * F.col(f"a{i}")).alias(f"x{k}_{i}") for k, t in enumerate(t2) for i in range(self.m)))
        d = self.second.join(corrected, "h").select("h", "nh", *((F.col(f"a{i}") - F.col(f"x{k}_{i}")).alias(f"b{k}_{i}") for k in range(len(t2)) for i in range(self.m)))
        d = written(d, "starts")
        unit = d.agg(*(F.sqrt(F.sum(F.col(f"b{k}_{i}") * F.col(f"b{k}_{i}"))) for k in range(len(t2)) for i in range(self.m))).first()
        unit = np.array([x or 1.0 for x in unit], float).reshape(len(t2), self.m)
        unit[unit == 0] = 1.0
        if self.exact:
            order = sorted(r[0] for r in d.select("h").collect())
            probes = [(F.col("h") == h).cast("double") for h in order]
        else:
            probes = [(F.pmod(F.xxhash64("h", F.lit(k)), F.lit(2)) * 2 - 1).cast("double") for k in range(self.probes)]
        columns = []
        for k in range(len(t2)):
            b = [F.col(f"b{k}_{i}") / float(unit[k, i]) for i in range(self.m)]
            columns += [b[i] if i == j else b[i] + b[j] for i in range(self.m) for j in range(i, self.m)] + probes
        return d.select("h", "nh", *(c.alias(f"c{k}") for k, c in enumerate(columns))), unit, len(columns)

    def _run(self, scales: Sequence[float], of_first: dict, steps: int, tolerance: float) -> None:
        state, unit, width = self._starts(scales)
        per = width // len(scales)
        c, cols = [F.col(f"c{k}") for k in range(width)], range(width)
        t2 = [scales[k // per] ** 2 for k in cols]
        state = written(state, "lanczos")
        length = np.array([x or 0.0 for x in state.agg(*(F.sum(x * x) for x in c)).first()], float)
        now = state.select("h", "nh", *((x / F.lit(math.sqrt(s) or 1.0)).alias(f"c{k}") for k, (x, s) in enumerate(zip(c, length))))
        alphas, betas, last = [], [], None
        for alpha, beta in islice(self._few_steps(now, t2) if self.few else self._many_steps(now, t2), steps):
            alphas.append(alpha)
            betas.append(beta)
            for k, t in enumerate(scales):
                part = slice(k * per, (k + 1) * per)
                self._known[t] = Profile(*of_first[t], unit[k], length[part], np.array(alphas)[:, part], np.array(betas)[:, part])
            profile = np.array([[self.deviance(t, s) for s in SCALES] for t in scales])
            if not beta.any() or last is not None and np.isfinite(profile).all() and np.abs(profile - last).max() <= tolerance * np.abs(profile).max():
                break
            last = profile

    def _few_steps(self, now: DataFrame, t2: Sequence[float]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Coefficients of the steps, one after the other; the first factor's levels are an index into arrays."""
        spark, width = now.sparkSession, len(t2)
        known = sorted((r["g"], r["ng"]) for r in self.first.select("g", "ng").collect())
        weight = np.array([[t / (1 + t * ng) for t in t2] for _, ng in known])
        index = F.broadcast(spark.createDataFrame([(g, i) for i, (g, _) in enumerate(known)], "g string, at int"))
        rows = self.pairs.join(index, "g").groupBy("h").agg(F.array_sort(F.collect_list(F.struct("at", F.col("n").cast("double").alias("n")))).alias("r"))
        vector = F.array(*(f"c{k}" for k in range(width)))
        state = written(now.join(rows, "h").select(F.col("nh").cast("double").alias("nh"), "r.at", "r.n", F.array_repeat(F.lit(0.0), width).alias("q"), vector.alias("w")), "lanczos")

        def sums() -> np.ndarray:
            out = np.zeros((2 + len(known)) * width)
            for i, x in state.mapInArrow(_sums(len(known), width), "i int, x double").groupBy("i").agg(F.sum("x")).collect():
                out[i] = x
            return out.reshape(-1, width)

        # N' q follows from N' w as q does from w.
        product, alpha, scale, beta = sums()[2:], np.zeros(width), np.ones(width), np.zeros(width)
        while True:
            state = written(state.mapInArrow(_next_vectors(len(known), width, alpha, scale, beta, weight * product), _ROW), "lanczos")
            alpha, square, *after = sums()
            beta = _step_length(alpha, square)
            yield alpha, beta
            scale = np.divide(1.0, beta, out=np.zeros(width), where=beta != 0)
            product = (np.array(after) - alpha * product) * scale

    def _many_steps(self, now: DataFrame, t2: Sequence[float]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same by joins with the pair table, for any number of levels of both factors."""
        width = len(t2)
        cols, beta = range(width), np.zeros(width)
        c = [F.col(f"c{k}") for k in cols]
        now = now.select("h", "nh", *c, *(F.lit(0.0).alias(f"p{k}") for k in cols))
        while True:
            first = self.pairs.join(now.select("h", *(f"c{k}" for k in cols)), "h").groupBy("g").agg(F.first("ng").alias("ng"), *(F.sum(F.col("n") * x).alias(f"c{k}") for k, x in enumerate(c)))
            first = first.select("g", *((x * (t / (1 + t * F.col("ng")))).alias(f"c{k}") for k, (x, t) in enumerate(zip(c, t2))))
            back = self.pairs.drop("ng").join(first, "g").groupBy("h").agg(*(F.sum(F.col("n") * x).alias(f"s{k}") for k, x in enumerate(c)))
            w = now.join(back, "h").select("h", "nh", *(f"c{k}" for k in cols), *((F.col("nh") * c[k] - F.col(f"s{k}") - float(beta[k]) * F.col(f"p{k}")).alias(f"w{k}") for k in cols))
            w = written(w, "lanczos")
            sums = np.array(w.agg(*(F.sum(c[k] * F.col(f"w{k}")) for k in cols), *(F.sum(F.col(f"w{k}") * F.col(f"w{k}")) for k in cols)).first(), float)
            alpha, square = sums[:width], sums[width:]
            beta = _step_length(alpha, square)
            yield alpha, beta
            now = w.select("h", "nh", *(((F.col(f"w{k}") - float(alpha[k]) * c[k]) * (1.0 / beta[k] if beta[k] else 0.0)).alias(f"c{k}") for k in cols), *(c[k].alias(f"p{k}") for k in cols))

    def _solve(self, t: float, s: float) -> tuple[float, float, np.ndarray]:
        """(log determinants, r^2, beta) at both scales."""
        p, s2 = self._known[float(t)], s * s
        pairs = self.m * (self.m + 1) // 2
        inverse, logs = np.zeros(pairs), 0.0
        for k, (weight, value) in enumerate(p.spectra):
            if k < pairs:
                inverse[k] = p.length[k] * np.sum(weight / (1 + s2 * value))
            else:
                logs += p.length[k] * np.sum(weight * np.log1p(s2 * value)) / (1 if self.exact else self.probes)
        q = np.zeros((self.m, self.m))
        q[np.triu_indices(self.m)] = inverse
        own = np.diag(q).copy()
        q = np.where(np.eye(self.m, dtype=bool), own, (q + q.T - own[:, None] - own[None, :]) / 2)
        matrix = p.cross - s2 * q * np.outer(p.unit, p.unit)
        x = matrix[:-1, :-1]
        scale = np.sqrt(np.maximum(np.diag(x), 0.0))
        scale[scale == 0] = 1.0
        beta = np.linalg.lstsq(x / np.outer(scale, scale), matrix[:-1, -1] / scale, rcond=None)[0] / scale
        return p.logdet + logs, matrix[-1, -1] - beta @ matrix[:-1, -1], beta

    def deviance(self, t: float, s: float) -> float:
        """At scale t of the first factor (profiled before) and s of the second."""
        logdet, r2, _ = self._solve(t, abs(s))
        if not r2 > 0:  # too few steps for so large a scale
            return math.inf
        return float(logdet + self.n * (1.0 + math.log(2 * math.pi * r2 / self.n)))

    def best_scale(self, t: float) -> tuple[float, float]:
        """(deviance, scale of the second factor) at its least, by finer and finer grids."""
        grid = SCALES
        for _ in range(5):
            values = [self.deviance(t, s) for s in grid]
            k = int(np.argmin(values))
            best = (values[k], float(grid[k]))
            lo, hi = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
            grid = np.linspace(lo, hi, 9)
        return best


def fit(df: DataFrame, response: str, fixed: Sequence[str], first: str, second: str, probes: int = 16, steps: int = 60) -> Fit:
    """ML fit with both scales chosen by finer and finer grids of the first and a profile of the second.

    Rows with a missing value in any of the columns are left out; without a complete row everything is NaN."""
    data = CrossedData(df, response, fixed, first, second, probes)
    x = data.m - 1
    if not data.n:
        nan = float("nan")
        return Fit(nan, x + 3, np.full(x, nan), nan, np.full(2, nan), nan, 0)
    grid = list(COARSE)
    for turn in range(GRIDS + 1):
        data.profiles(grid, steps)
        known = sorted(data._known)
        k = min(range(len(known)), key=lambda i: data.best_scale(known[i])[0])
        if turn < GRIDS:
            grid = list(np.linspace(known[max(k - 1, 0)], known[min(k + 1, len(known) - 1)], FINE))
    t = known[k]
    deviance, s = data.best_scale(t)
    _, r2, beta = data._solve(t, s)
    sigma2 = r2 / data.n
    slopes = beta[1:]
    var_fixed = float(slopes @ data.gram[1:-1, 1:-1] @ slopes) / (data.n - 1) if data.n > 1 else float("nan")
    beta = np.concatenate([[beta[0] + data.centre[-1] - slopes @ np.array(data.centre[1:-1])], slopes])
    return Fit(deviance=deviance, npar=x + 3, beta=beta, sigma2=sigma2, var_random=np.array([t * t, s * s]) * sigma2, var_fixed=var_fixed, n=data.n)
