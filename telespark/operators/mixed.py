"""Random-intercept linear mixed models by maximum likelihood, likelihood
ratio tests, R-squared, and stepwise selection of random and fixed terms.

One factor, the grouping factor, may have any number of levels and is never
collected.  One scan of the rows makes the *level table*: for each level and
each pattern of missing values, the row count, the sum of every column and of
every product of two columns.  Every set of complete rows that a comparison
of two models uses is a union of patterns, so no later step reads the rows.

For a relative scale theta of the grouping factor, the profiled ML deviance

    d(theta) = log|L|^2 + n (1 + log(2 pi r^2 / n))

needs of the levels only ``sum log(1 + theta^2 n_j)`` and the matrix
``sum theta^2 / (1 + theta^2 n_j) a_j a_j'`` over the level sums ``a_j``.
Both weigh a level by its size alone, so the levels are summed by size into
the *size table*, which serves every theta, model and response.  It comes to
the driver while it is small (``MAX_SIZES`` rows), else each grid of thetas is
one aggregate over it, for all models together; the results are the same.

The other factors are categories with up to ``MAX_CATEGORIES`` levels; their
levels are columns, as a text term's are, with scales of their own that are
optimised in the small system.  Two factors with many levels each:
``telespark.operators.crossed``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telespark.functions.nulls import nan_to_null
from telespark.session import written

INTERCEPT = "(Intercept)"
#: Relative scales of the grouping factor on the first grid; points of a finer grid, and how many follow.
COARSE, FINE, GRIDS = (0.0, *np.geomspace(1e-3, 1e3, 33)), 17, 4
#: Levels of a category; rows of the size table that come to the driver.
MAX_CATEGORIES, MAX_SIZES = 200, 20_000
#: Sets of complete rows that are summed at once, before a model asks for them.
MAX_CASES = 64


# ------------------------------------------------------------------ statistics

def category_levels(d: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Levels of categorical columns as text.  They are counted before any of them is collected."""
    if not columns:
        return {}
    d = d.select(*(F.col(c).cast("string").alias(c) for c in columns))
    about = d.agg(*(F.approx_count_distinct(c).alias(c) for c in columns)).first()
    many = [c for c in columns if about[c] > 1.2 * MAX_CATEGORIES]
    found: dict[str, list[str]] = {c: [] for c in columns}
    if not many:
        for name, level in d.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns))).alias("x")).select("x.*").dropna().distinct().collect():
            found[name].append(level)
        many = [c for c in columns if len(found[c]) > MAX_CATEGORIES]
    if many:
        raise ValueError(f"{', '.join(many)}: more than {MAX_CATEGORIES} levels; make it the grouping factor, or use telespark.operators.crossed")
    return {c: sorted(v) for c, v in found.items()}


def _design(df: DataFrame, fixed: Sequence[str], levels: dict[str, list[str]]) -> tuple[DataFrame, list[str], dict]:
    """Numeric terms as they are; text terms as treatment dummies (the first
    level is the reference)."""
    cols: dict[str, object] = {INTERCEPT: F.lit(1.0)}
    terms: dict[str, list[str]] = {}
    for t in fixed:
        if t in levels:
            terms[t] = [f"{t}{lv}" for lv in levels[t][1:]]
            cols.update({nm: (F.col(t) == lv).cast("double") for lv, nm in zip(levels[t][1:], terms[t])})
        else:
            cols[t] = F.col(t).cast("double")
            terms[t] = [t]
    return df.withColumns({f"_x_{k}": v for k, v in cols.items()}), list(cols), terms


def stats_frame(df: DataFrame, responses: Sequence[str], fixed: Sequence[str],
                random: Sequence[str]) -> tuple[DataFrame, list[str], dict[str, list[str]]]:
    """One aggregation with grouping sets () / (factor) / (factor pair) over
    the complete cases: row count and the sums of products of every pair of
    design and response columns (products with the intercept are the plain
    sums).  Its size is 1 + levels + co-occurring level pairs."""
    used = list(dict.fromkeys([*responses, *fixed, *random]))
    types = dict(df.dtypes)
    d = df.select(*[nan_to_null(c).alias(c) if types[c] in ("double", "float") else F.col(c) for c in used]).dropna()
    d = d.withColumns({r: F.col(r).cast("string") for r in random})
    d, columns, terms = _design(d, fixed, category_levels(d, [t for t in fixed if types[t] == "string"]))
    allv = [F.col(f"_x_{c}") for c in columns] + [F.col(r).cast("double") for r in responses]
    m = len(allv)
    sets = [[]] + [[r] for r in random] + [list(p) for p in combinations(random, 2)]
    aggs = [F.count(F.lit(1)).alias("n")] + [
        F.sum(allv[i] * allv[j]).alias(f"s{i}_{j}") for i in range(m) for j in range(i, m)]
    if random:
        g = d.groupingSets(sets, *random).agg(F.grouping_id().alias("gid"), *aggs)
    else:
        g = d.agg(F.lit(0).alias("gid"), *aggs)
    return g, columns, terms


@dataclass
class Moments:
    """Of one set of complete rows: count, products of all columns, levels by
    size (sizes, how many, summed products of their sums) or, where there are
    too many sizes, their table, and for each theta the log determinant and
    the grouping factor's correction."""

    n: int
    gram: np.ndarray
    sizes: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    table: DataFrame | None = None
    grid: dict[float, tuple[float, np.ndarray]] = field(default_factory=dict)


class MixedData:
    """The statistics that the candidate models of a selection need."""

    def __init__(self, df: DataFrame, responses: Sequence[str], fixed: Sequence[str], group: str, factors: Sequence[str] = ()):
        self.group, self.responses = group, list(responses)
        used = list(dict.fromkeys([*responses, *fixed, *factors, group]))
        types = dict(df.dtypes)
        d = written(df.select(*[nan_to_null(c).alias(c) if types[c] in ("double", "float") else F.col(c) for c in used]), "model-rows")
        levels = category_levels(d, [*(t for t in fixed if types[t] == "string"), *(f for f in factors if f not in fixed or types[f] != "string")])
        d, self.columns, terms = _design(d, fixed, {t: lv for t, lv in levels.items() if types[t] == "string"})
        self.terms = {t: [self.columns.index(c) for c in cs] for t, cs in terms.items()}
        values = {c: F.col(f"_x_{c}") for c in self.columns}
        self.factors: dict[str, list[int]] = {}
        for f in factors:  # categories: a column for each level
            names = [f"{f}={lv}" for lv in levels[f]]
            values.update({n: (F.col(f).cast("string") == lv).cast("double") for n, lv in zip(names, levels[f])})
            self.factors[f] = list(range(len(self.columns), len(self.columns) + len(names)))
            self.columns += names
        for r in responses:
            values[f"y:{r}"] = F.col(r).cast("double")
            self.columns.append(f"y:{r}")
        # A value that is missing counts as 0: only rows complete in the columns of a pair enter its sums.
        self.bit = {c: i for i, c in enumerate(used)}
        there = sum((F.col(c).isNotNull().cast("long") * (1 << i) for c, i in self.bit.items()), F.lit(0).cast("long"))
        rows = d.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("_g"), there.alias("_has"),
                                                        *(F.coalesce(values[c], F.lit(0.0)).alias(f"_v{i}") for i, c in enumerate(self.columns)))
        v = [F.col(f"_v{i}") for i in range(len(self.columns))]
        self.levels = written(rows.groupBy("_g", "_has").agg(F.count("*").alias("n"), F.array(*map(F.sum, v)).alias("a"), F.array(*map(F.sum, _products(v))).alias("p")), "levels")
        k = len(_products(v))
        self._patterns = {r["_has"]: (r["n"], self._matrix(r["p"])) for r in self.levels.groupBy("_has").agg(
            F.sum("n").alias("n"), F.array(*(F.sum(F.col("p")[i]) for i in range(k))).alias("p")).collect()}
        self._known: dict[frozenset, Moments] = {}
        self._best: dict[tuple, tuple[float, np.ndarray]] = {}  # least deviance at a theta
        self._own: dict[tuple, set[float]] = {}  # thetas at which a model is looked at

    def case(self, model: Model, response: str) -> frozenset:
        """The set of complete rows of a model: the patterns that have all of its columns."""
        needed = sum(1 << self.bit[c] for c in {response, self.group, *model.fixed, *model.random})
        return frozenset(p for p in self._patterns if p & needed == needed)

    def _matrix(self, values: Sequence[float]) -> np.ndarray:
        m = len(self.columns)
        out = np.zeros((m, m))
        out[np.triu_indices(m)] = [x or 0.0 for x in values]
        return out + np.triu(out, 1).T

    def moments(self, cases: Sequence[frozenset]) -> None:
        """Products and level sizes of the given sets of complete rows, on the coarse grid."""
        new = [c for c in dict.fromkeys(cases) if c not in self._known]
        if not new:
            return
        if not self._known:  # where there are few, all sets that any model can use come with the first
            every = {frozenset(self._patterns)}
            for i in self.bit.values():
                every |= {frozenset(p for p in c if p >> i & 1) for c in every}
                if len(every) > MAX_CASES:
                    break
            else:
                new = list(dict.fromkeys([*new, *sorted(every, key=len)]))
        m = len(self.columns)
        for c in new:
            self._known[c] = Moments(sum(self._patterns[p][0] for p in c), sum((self._patterns[p][1] for p in c), np.zeros((m, m))))
        there = [c for c in new if c]
        if there:
            fits = F.array(*(F.when(F.col("_has").isin(sorted(c)), F.lit(i)) for i, c in enumerate(there)))
            level = self.levels.withColumn("_case", F.explode(F.array_compact(fits))).groupBy("_case", "_g").agg(
                F.sum("n").alias("n"), *(F.sum(F.col("a")[i]).alias(f"a{i}") for i in range(m)))
            sizes = written(level.groupBy("_case", "n").agg(F.count("*").alias("levels"), F.array(*map(F.sum, _products([F.col(f"a{i}") for i in range(m)]))).alias("s")), "sizes")
            if sizes.count() <= MAX_SIZES:
                rows = sizes.collect()
                for i, c in enumerate(there):
                    own = [r for r in rows if r["_case"] == i]
                    self._known[c].sizes = (np.array([r["n"] for r in own], float), np.array([r["levels"] for r in own], float), np.array([self._matrix(r["s"]) for r in own]))
            else:
                for i, c in enumerate(there):
                    self._known[c].table = sizes.where(F.col("_case") == i)
        self.refine({c: COARSE for c in there})

    def refine(self, wanted: dict[frozenset, Iterable[float]]) -> None:
        """Add thetas to the grids: from the sizes on the driver, or by one aggregate over the size tables."""
        parts, cases = [], list(wanted)
        for i, c in enumerate(cases):
            mom = self._known[c]
            thetas = [t for t in dict.fromkeys(map(float, wanted[c])) if t not in mom.grid]
            if mom.sizes is not None:
                n, levels, s = mom.sizes
                for t in thetas:
                    mom.grid[t] = (float(np.sum(levels * np.log1p(t * t * n))), np.tensordot(t * t / (1 + t * t * n), s, 1))
            elif thetas:
                parts.append(mom.table.select(F.lit(i).alias("i"), "n", "levels", "s", F.explode(F.array(*map(F.lit, thetas))).alias("theta")))
        if not parts:
            return
        d = reduce(DataFrame.unionByName, parts)
        t2 = F.col("theta") * F.col("theta")
        d = d.withColumn("w", t2 / (1 + t2 * F.col("n")))
        k = len(_products(self.columns))
        g = d.groupBy("i", "theta").agg(F.sum(F.col("levels") * F.log1p(t2 * F.col("n"))).alias("logdet"), F.array(*(F.sum(F.col("w") * F.col("s")[j]) for j in range(k))).alias("g"))
        for r in g.collect():
            self._known[cases[r["i"]]].grid[r["theta"]] = (r["logdet"], self._matrix(r["g"]))


def _products(v: Sequence) -> list:
    """Every product of two columns, the upper triangle by rows."""
    if isinstance(v[0], str):
        return [(a, b) for i, a in enumerate(v) for b in v[i:]]
    return [a * b for i, a in enumerate(v) for b in v[i:]]


def deviance_profile(df: DataFrame, response: str, term: str, group: str, thetas: Iterable[float]) -> list[tuple[float, int, float]]:
    """(theta, n, deviance) of ``response ~ term + (1|group)`` at the given scales, as the fits compute it."""
    data, model, thetas = MixedData(df, [response], [term], group), Model((term,), (group,), ""), list(map(float, thetas))
    c = data.case(model, response)
    data.moments([c])
    data.refine({c: thetas})
    mom = data._known[c]
    return [(t, mom.n, deviance(data, mom, model, response, [t])) for t in thetas] if mom.n else []


# ------------------------------------------------------------------ fitting

@dataclass(frozen=True)
class Model:
    """``random`` starts with the grouping factor (or is empty)."""

    fixed: tuple[str, ...]
    random: tuple[str, ...]
    text: str


@dataclass
class Fit:
    deviance: float
    npar: int
    beta: np.ndarray
    sigma2: float
    var_random: np.ndarray
    var_fixed: float
    n: int

    @property
    def loglik(self) -> float:
        return -self.deviance / 2

    @property
    def aic(self) -> float:
        return self.deviance + 2 * self.npar

    @property
    def bic(self) -> float:
        return self.deviance + self.npar * math.log(self.n)


def _fixed_columns(data: MixedData, model: Model) -> list[int]:
    return [0] + [c for t in model.fixed for c in data.terms[t]]


class _System:
    """The small system of a model with the grouping factor's scale fixed; ``theta[0]`` has to be on the grid."""

    def __init__(self, data: MixedData, mom: Moments, model: Model, response: str, theta0: float):
        x, y = _fixed_columns(data, model), data.columns.index(f"y:{response}")
        self.logdet, corr = mom.grid[float(theta0)] if model.random else (0.0, 0.0)
        m = mom.gram - corr
        z = [(c, i) for i, f in enumerate(model.random[1:]) for c in data.factors[f]]
        cols = [c for c, _ in z] + x
        self.q, self.owner = len(z), [i for _, i in z]
        self.k, self.b, self.yy = m[np.ix_(cols, cols)], m[cols, y], m[y, y]
        self.eye = np.diag([1.0] * self.q + [0.0] * len(x))

    def solve(self, scales: Sequence[float]) -> tuple[float, float, np.ndarray]:
        """Penalised least squares with the scales of the other factors: (log|L|^2, r^2, beta)."""
        scale = np.ones(len(self.b))
        scale[: self.q] = np.asarray(scales, float)[self.owner] if self.q else ()
        k, b = self.k * np.outer(scale, scale) + self.eye, self.b * scale
        unit = np.sqrt(np.maximum(np.diag(k), 0.0))
        unit[unit == 0] = 1.0  # columns of very different size are no reason to drop one
        k, b = k / np.outer(unit, unit), b / unit
        logdet = self.logdet
        try:  # the random columns come first: one factorisation has the determinant too
            low = np.linalg.cholesky(k)
            if np.diag(low).min(initial=1.0) < 1e-6:
                raise np.linalg.LinAlgError
            half = np.linalg.solve(low, b)
            r2, sol = self.yy - half @ half, np.linalg.solve(low.T, half) / unit
            if self.q:
                logdet += 2 * np.sum(np.log(np.diag(low)[: self.q] * unit[: self.q]))
        except np.linalg.LinAlgError:  # collinear terms
            sol = np.linalg.lstsq(k, b, rcond=None)[0]
            r2, sol = self.yy - sol @ b, sol / unit
            if self.q:
                logdet += np.linalg.slogdet(k[: self.q, : self.q])[1] + 2 * np.sum(np.log(unit[: self.q]))
        return logdet, r2, sol[self.q :]

    def deviance(self, n: int, scales: Sequence[float]) -> float:
        logdet, r2, _ = self.solve(np.abs(scales))
        return logdet + n * (1.0 + math.log(2 * math.pi * max(r2, 1e-300) / n))


def deviance(data: MixedData, mom: Moments, model: Model, response: str, theta: Sequence[float]) -> float:
    return _System(data, mom, model, response, theta[0] if len(theta) else 0.0).deviance(mom.n, theta[1:])


def _nelder_mead(f, x0, tol=1e-10, max_iter=2000):
    n = len(x0)
    pts = [np.asarray(x0, float)]
    for i in range(n):
        e = np.array(x0, float)
        e[i] = e[i] + (0.5 if e[i] == 0 else 0.5 * e[i])
        pts.append(e)
    vals = [f(p) for p in pts]
    for _ in range(max_iter):
        order = np.argsort(vals)
        pts = [pts[i] for i in order]
        vals = [vals[i] for i in order]
        if abs(vals[-1] - vals[0]) <= tol * (abs(vals[0]) + tol):
            break
        c = np.mean(pts[:-1], axis=0)
        xr = c + (c - pts[-1])
        fr = f(xr)
        if fr < vals[0]:
            xe = c + 2 * (c - pts[-1])
            fe = f(xe)
            pts[-1], vals[-1] = (xe, fe) if fe < fr else (xr, fr)
        elif fr < vals[-2]:
            pts[-1], vals[-1] = xr, fr
        else:
            xc = c + 0.5 * (pts[-1] - c)
            fc = f(xc)
            if fc < vals[-1]:
                pts[-1], vals[-1] = xc, fc
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                vals = [vals[0]] + [f(p) for p in pts[1:]]
    i = int(np.argmin(vals))
    return pts[i], vals[i]


def _at(data, mom, model, response, theta0: float, start: np.ndarray | None) -> tuple[float, np.ndarray]:
    """Least deviance, and the scales, with the grouping factor's scale fixed; ``start``: the scales at a scale nearby."""
    rest, system = len(model.random) - 1, _System(data, mom, model, response, theta0)
    if rest <= 0:
        return system.deviance(mom.n, ()), np.array([theta0] if model.random else [])
    at = np.ones(rest) if start is None else np.maximum(start[1:], 0.01)
    best, dev = _nelder_mead(lambda t: system.deviance(mom.n, t), at)
    theta = np.array([theta0, *np.abs(best)])
    for i in range(1, rest + 1):  # the boundary of each scale
        t0 = theta.copy()
        t0[i] = 0.0
        if (d0 := system.deviance(mom.n, t0[1:])) < dev:
            theta, dev = t0, d0
    return dev, theta


def _profile(data: MixedData, c: frozenset, model: Model, response: str) -> list[tuple[float, float, np.ndarray]]:
    """(theta0, deviance, scales) along the model's own thetas."""
    mom, out = data._known[c], []
    for t in sorted(data._own.setdefault((c, model, response), set(COARSE))) if model.random else [0.0]:
        key = (c, model, response, t)
        if key not in data._best:
            data._best[key] = _at(data, mom, model, response, t, out[-1][2] if out else None)
        out.append((t, *data._best[key]))
    return out


def _bracket(profile) -> tuple[float, float]:
    k = min(range(len(profile)), key=lambda i: profile[i][1])
    return profile[max(k - 1, 0)][0], profile[min(k + 1, len(profile) - 1)][0]


def _finer(lo: float, hi: float) -> np.ndarray:
    return np.linspace(lo, hi, FINE) if lo == 0.0 else np.geomspace(lo, hi, FINE)


def fits(data: MixedData, wanted: Sequence[tuple[Model, str, frozenset]]) -> list[Fit]:
    """ML fits of (model, response, complete rows); each finer grid is one
    aggregate for all models together."""
    data.moments([c for _, _, c in wanted])
    for _ in range(GRIDS):
        more: dict[frozenset, list[float]] = {}
        for model, response, c in dict.fromkeys(wanted):
            if model.random and data._known[c].n:
                finer = _finer(*_bracket(_profile(data, c, model, response)))
                more.setdefault(c, []).extend(finer)
                data._own[c, model, response].update(map(float, finer))
        data.refine(more)
    return [_fit(data, c, model, response) for model, response, c in wanted]


def _fit(data: MixedData, c: frozenset, model: Model, response: str) -> Fit:
    mom = data._known[c]
    if not mom.n:  # no complete row
        nan, x = float("nan"), _fixed_columns(data, model)
        return Fit(nan, len(x) + len(model.random) + 1, np.full(len(x), nan), nan, np.full(len(model.random), nan), nan, 0)
    _, dev, theta = min(_profile(data, c, model, response), key=lambda p: p[1])
    _, r2, beta = _System(data, mom, model, response, theta[0] if len(theta) else 0.0).solve(theta[1:])
    x, n = _fixed_columns(data, model), mom.n
    xx = mom.gram[np.ix_(x, x)]
    xb = xx[0] @ beta                        # sum of the fitted fixed part
    var_fixed = (beta @ xx @ beta - xb * xb / n) / (n - 1) if n > 1 else float("nan")
    sigma2 = r2 / n
    return Fit(deviance=dev, npar=len(beta) + len(model.random) + 1, beta=beta, sigma2=sigma2,
               var_random=theta ** 2 * sigma2, var_fixed=var_fixed, n=n)


# ------------------------------------------------------------------ tests

def chi2_sf(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution (regularised gamma Q)."""
    if x <= 0 or df <= 0:
        return 1.0 if df > 0 else float("nan")
    a, z = df / 2.0, x / 2.0
    if z < a + 1:
        term = total = 1.0 / a
        ap = a
        for _ in range(10000):
            ap += 1
            term *= z / ap
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return max(0.0, 1.0 - total * math.exp(-z + a * math.log(z) - math.lgamma(a)))
    b = z + 1 - a
    c = 1e300
    d = 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-16:
            break
    return math.exp(-z + a * math.log(z) - math.lgamma(a)) * h


def r_squared(f: Fit) -> tuple[float, float]:
    """Marginal and conditional R-squared (fixed; fixed + random variance
    over the total)."""
    vr = float(np.sum(f.var_random))
    tot = f.var_fixed + vr + f.sigma2
    return f.var_fixed / tot, (f.var_fixed + vr) / tot


def compare(null: Model, alt: Model, fn: Fit, fa: Fit) -> dict:
    """Likelihood-ratio row of ``alt`` against ``null`` with R-squared of alt."""
    chisq = max(fn.deviance - fa.deviance, 0.0)
    dfree = fa.npar - fn.npar
    r2m, r2c = r_squared(fa)
    return {"nullmodel": null.text, "model": alt.text, "npar": float(fa.npar), "AIC": fa.aic,
            "BIC": fa.bic, "logLik": fa.loglik, "deviance": fa.deviance, "Chisq": chisq,
            "Df": float(dfree), "p_value": chi2_sf(chisq, dfree) if dfree > 0 else None,
            "R2m": r2m, "R2c": r2c}


# ------------------------------------------------------------------ selection

def _random_text(r: str, base: str) -> str:
    return f"(1| {r} ) + {base}"


def _fixed_text(f: str, base: str) -> str:
    return f"{f} + {base}"


def scan(data: MixedData, response: str, features: Sequence[str], null: Model,
         mode: str) -> list[tuple[Model, dict]]:
    """Test each feature on top of ``null`` (last feature first), both models
    on the rows that are complete in the larger one's columns."""
    alts = []
    for ft in reversed(list(features)):
        if mode == "random":
            alts.append(Model(null.fixed, (*null.random, ft), _random_text(ft, null.text)))
        else:
            alts.append(Model((*null.fixed, ft), null.random, _fixed_text(ft, null.text)))
    found = fits(data, [(m, response, data.case(alt, response)) for alt in alts for m in (null, alt)])
    return [(alt, compare(null, alt, *found[2 * k : 2 * k + 2])) for k, alt in enumerate(alts)]


def _flag(rows: list[dict], threshold: float) -> None:
    r2 = [r["R2m"] for r in rows]
    top = None if any(v is None or (isinstance(v, float) and math.isnan(v)) for v in r2) \
        else max(r2) if r2 else None
    for r in rows:
        p = r["p_value"]
        r["p_pass"] = p is not None and p < threshold
        r["r2_pass"] = bool(r["p_pass"] and top is not None and r["R2m"] == top)


def step(data, response, features, null: Model, threshold, table, models, mode):
    """Forward step: test, flag, adopt the last passing model, repeat."""
    found = scan(data, response, features, null, mode)
    rows = [dict(r, stage=mode) for _, r in found]
    _flag(rows, threshold)
    for (m, _), r in zip(found, rows):
        models[m.text] = m
    table.extend(rows)
    passing = [r for r in table if r["p_pass"] and r["r2_pass"]]
    base_text = passing[-1]["model"] if passing else null.text
    if base_text != null.text:
        new_null = models[base_text]
        terms = set(new_null.fixed) | set(new_null.random)
        rest = [f for f in features if f not in terms]
        if rest:
            rows += step(data, response, rest, new_null, threshold, table, models, mode)
    return rows


def select(data: MixedData, random: Sequence[str], fixed: Sequence[str], threshold: float = 0.05,
           carry_random: bool = False) -> list[dict]:
    """Stepwise selection per response (last response first): random terms,
    then fixed terms.  The fixed stage starts from the base model, as the
    reference does (its R2m sort puts the base, with no R2m, last); with
    ``carry_random`` it starts from the best random model instead."""
    out = []
    null = data.group
    for resp in reversed(data.responses):
        base = Model((), (null,), f"(1| {null} )")
        base_row = {"Predicted": resp, "nullmodel": None, "model": base.text, "npar": None,
                    "AIC": None, "BIC": None, "logLik": None, "deviance": None, "Chisq": None,
                    "Df": None, "p_value": None, "R2m": None, "R2c": None,
                    "p_pass": True, "r2_pass": True, "stage": "base"}
        table = [base_row]
        models = {base.text: base}
        step(data, resp, list(random), base, threshold, table, models, "random")
        start = base
        if carry_random:
            ok = [r for r in table if r["p_pass"] and r["r2_pass"] and r["R2m"] is not None]
            if ok:
                start = models[max(ok, key=lambda r: r["R2m"])["model"]]
        step(data, resp, list(fixed), start, threshold, table, models, "fixed")
        for r in table:
            r["Predicted"] = resp
        out.extend(table)
    return out


RESULT_SCHEMA = T.StructType(
    [T.StructField("Predicted", T.StringType()), T.StructField("stage", T.StringType()),
     T.StructField("nullmodel", T.StringType()), T.StructField("model", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in
       ("npar", "AIC", "BIC", "logLik", "deviance", "Chisq", "Df", "p_value", "R2m", "R2c")]
    + [T.StructField("p_pass", T.BooleanType()), T.StructField("r2_pass", T.BooleanType())])


def to_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The (small) model table as a DataFrame."""
    kinds = {f.name: f.dataType for f in RESULT_SCHEMA.fields}

    def conv(v, t):
        if v is None:
            return None
        if isinstance(t, T.BooleanType):
            return bool(v)
        if isinstance(t, T.DoubleType):
            return float(v)
        return str(v)

    data = [tuple(conv(r.get(c), kinds[c]) for c in kinds) for r in rows]
    return spark.createDataFrame(data, RESULT_SCHEMA)


def lmm_table(models: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Final table: rounded statistics, sorted by response and descending
    R2m (numerically), only rows with p < alpha, pass flags dropped."""
    rounded = {c: F.round(c, 2) for c in ("AIC", "BIC", "logLik", "R2m", "R2c")}
    return (models.withColumns(rounded)
            .filter(F.col("p_value") < alpha)
            .drop("p_pass", "r2_pass")
            .withColumnsRenamed({"model": "Fixed Effect", "logLik": "ML"})
            .orderBy("Predicted", F.col("R2m").desc()))
