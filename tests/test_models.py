"""Fits and mixed models against dense numpy computations."""

import math

import numpy as np
import pandas as pd
import pytest

from telespark.operators import fit, mixed


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 500
    g = rng.integers(0, 10, n)
    h = rng.integers(0, 3, n)
    x = rng.normal(size=n)
    y = 2 + 0.8 * x + rng.normal(0, 1, 10)[g] + rng.normal(0, .5, 3)[h] + rng.normal(0, .6, n)
    pdf = pd.DataFrame({"y": y, "x": x, "z": rng.normal(size=n), "g": g.astype(float),
                        "h": [f"h{v}" for v in h], "c": rng.choice(["u", "v", "w"], n)})
    return pdf, spark.createDataFrame(pdf)


def _dense_deviance(pdf, theta, fixed, rand, response="y"):
    n = len(pdf)
    cols = [np.ones(n)]
    for f in fixed:
        if pdf[f].dtype == object:
            lv = sorted(pdf[f].unique())
            cols += [(pdf[f] == v).to_numpy(float) for v in lv[1:]]
        else:
            cols.append(pdf[f].to_numpy(float))
    X = np.column_stack(cols)
    Z = []
    for r, t in zip(rand, theta):
        lv = sorted(pdf[r].astype(str).unique())
        m = np.zeros((n, len(lv)))
        m[np.arange(n), [lv.index(v) for v in pdf[r].astype(str)]] = t
        Z.append(m)
    V = (np.column_stack(Z) @ np.column_stack(Z).T if Z else 0) + np.eye(n)
    y = pdf[response].to_numpy()
    Vi = np.linalg.inv(V)
    beta = np.linalg.solve(X.T @ Vi @ X, X.T @ Vi @ y)
    r = y - X @ beta
    return np.linalg.slogdet(V)[1] + n * (1 + math.log(2 * math.pi * (r @ Vi @ r) / n))


@pytest.mark.parametrize("fixed,rand", [(("x",), ("g",)), (("x", "c"), ("g", "h")), (("z",), ())])
def test_deviance_matches_dense(spark, data, fixed, rand):
    pdf, df = data
    d = mixed.MixedData(df, ["y"], ["x", "z", "c"], "g", ["h"])
    model = mixed.Model(fixed, rand, "m")
    case = d.case(model, "y")
    d.moments([case])
    d.refine({case: [0.9]})
    theta = [0.9, 0.3][: len(rand)]
    got = mixed.deviance(d, d._known[case], model, "y", theta)
    assert got == pytest.approx(_dense_deviance(pdf, theta, fixed, rand), rel=1e-10)


def test_large_values_and_offsets(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 6, 200)
    pdf = pd.DataFrame({"y": 1e14 + 1e13 * rng.normal(size=200) + 1e13 * g, "x": 1e7 * rng.normal(size=200), "g": [f"g{v}" for v in g]})
    d = mixed.MixedData(spark.createDataFrame(pdf), ["y"], ["x"], "g")
    model = mixed.Model(("x",), ("g",), "m")
    case = d.case(model, "y")
    d.moments([case])
    d.refine({case: [1.0]})
    assert mixed.deviance(d, d._known[case], model, "y", [1.0]) == pytest.approx(_dense_deviance(pdf, [1.0], ["x"], ["g"]), rel=1e-6)


def test_fit_is_minimum(spark, data):
    pdf, df = data
    d = mixed.MixedData(df, ["y"], ["x"], "g", ["h"])
    one, two = mixed.Model(("x",), ("g",), "m"), mixed.Model(("x",), ("g", "h"), "m")
    f, f2 = mixed.fits(d, [(m, "y", d.case(m, "y")) for m in (one, two)])
    least = min(_dense_deviance(pdf, [t], ["x"], ["g"]) for t in np.geomspace(0.8, 3, 60))
    assert least - 0.01 <= f.deviance <= least + 1e-6
    assert f.beta[1] == pytest.approx(0.8, abs=0.15)
    t0, t1 = np.sqrt(f2.var_random / f2.sigma2)
    assert f2.deviance == pytest.approx(_dense_deviance(pdf, [t0, t1], ["x"], ["g", "h"]), rel=1e-9)
    for a in (0.97, 1.03):
        assert f2.deviance <= _dense_deviance(pdf, [t0 * a, t1], ["x"], ["g", "h"])
        assert f2.deviance <= _dense_deviance(pdf, [t0, t1 * a], ["x"], ["g", "h"]) + 1e-9


def test_rows_complete_in_the_compared_pair_are_used(spark, data):
    pdf, _ = data
    pdf = pdf.copy()
    pdf.loc[:99, "z"] = np.nan        # missing in a candidate of another pair
    pdf.loc[100:129, "x"] = np.nan
    d = mixed.MixedData(spark.createDataFrame(pdf), ["y"], ["x", "z"], "g")
    base = mixed.Model((), ("g",), "(1| g )")
    rows = {m.fixed: r for m, r in mixed.scan(d, "y", ["x", "z"], base, "fixed")}
    for term in ("x", "z"):
        part = pdf.dropna(subset=[term])
        null = min(_dense_deviance(part, [t], [], ["g"]) for t in np.geomspace(0.4, 3, 80))
        alt = min(_dense_deviance(part, [t], [term], ["g"]) for t in np.geomspace(0.4, 3, 80))
        assert rows[(term,)]["deviance"] == pytest.approx(alt, abs=0.02)
        assert rows[(term,)]["Chisq"] == pytest.approx(null - alt, abs=0.03)


def test_deviance_profile_matches_dense(spark, data):
    pdf, df = data
    got = {t: v for t, _, v in mixed.deviance_profile(df, "y", "x", "g", [0.0, 0.7, 2.0])}
    for t, v in got.items():
        assert v == pytest.approx(_dense_deviance(pdf, [t], ["x"], ["g"]), rel=1e-10)


def test_chi2_sf():
    assert mixed.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-8)
    assert mixed.chi2_sf(0.5, 2) == pytest.approx(math.exp(-0.25), rel=1e-12)
    assert mixed.chi2_sf(30.0, 4) == pytest.approx(4.89e-06, rel=1e-2)


def test_selection_adds_true_terms(spark, data):
    _, df = data
    d = mixed.MixedData(df, ["y"], ["x", "z"], "g", ["h"])
    rows = mixed.select(d, ["h"], ["x", "z"])
    adopted = [r["model"] for r in rows if r["p_pass"] and r["r2_pass"] and r["stage"] != "base"]
    assert "(1| h ) + (1| g )" in adopted
    assert any(m.startswith("x + ") for m in adopted)
    assert not any(m.startswith("z + (1| g )") for m in adopted)
    tab = mixed.lmm_table(mixed.to_frame(spark, rows)).collect()
    assert all(r.p_value < 0.05 for r in tab)


def test_p_lin_matches_polyfit(spark, data):
    pdf, df = data
    got = fit.p_lin(df, "y", "x").toPandas()
    b, a = np.polyfit(pdf.x, pdf.y, 1)
    lo, hi = pdf.x.min(), pdf.x.max()
    assert len(got) == int(math.floor(hi * 100 - lo * 100)) + 1
    assert got.y.to_numpy() == pytest.approx(a + b * got.x.to_numpy(), rel=1e-9)


def test_spline_matches_the_natural_smoothing_spline(spark):
    """With a knot at every x, the fit is the natural cubic smoothing spline,
    solved here from second differences instead of B-splines."""
    rng = np.random.default_rng(5)
    x = np.sort(rng.uniform(-2, 7, 40))
    w = rng.integers(1, 4, 40)
    pdf = pd.DataFrame({"x": np.repeat(x, w)})
    pdf["y"] = np.sin(pdf.x) + rng.normal(0, 0.3, len(pdf))
    spar = 0.5
    got = fit.p_supsmu(spark.createDataFrame(pdf), "y", "x", spar=spar).toPandas().sort_values("x")
    assert np.allclose(got.x, x)
    u = (x - x[0]) / (x[-1] - x[0])
    # The scale of lambda, from basis functions by their recursive definition.
    t = np.concatenate([[u[0]] * 3, u, [u[-1]] * 3])

    def basis(i, k, v):
        if k == 0:
            return float(t[i] <= v < t[i + 1] or (v == t[-1] and t[i] < t[i + 1] == t[-1]))
        out = 0.0
        if t[i + k] > t[i]:
            out += (v - t[i]) / (t[i + k] - t[i]) * basis(i, k - 1, v)
        if t[i + k + 1] > t[i + 1]:
            out += (t[i + k + 1] - v) / (t[i + k + 1] - t[i + 1]) * basis(i + 1, k - 1, v)
        return out

    m = len(t) - 4
    trace_x = sum(w[j] * basis(i, 3, u[j]) ** 2 for i in range(m) for j in range(len(u)))
    fine = np.linspace(0, 1, 20001)[1:-1]
    step = fine[1] - fine[0]
    trace_o = 0.0
    for i in range(m):
        inside = fine[(fine > t[i] - 3 * step) & (fine < t[i + 4] + 3 * step)]
        trace_o += np.sum((np.diff([basis(i, 3, v) for v in inside], 2) / step**2) ** 2) * step
    assert np.trace(fit.penalty(u)) == pytest.approx(trace_o, rel=0.02)
    lam = trace_x / np.trace(fit.penalty(u)) * 256.0 ** (3 * spar - 1)
    h, n = np.diff(u), len(u)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j, j], q[j + 1, j], q[j + 2, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j:
            r[j - 1, j] = r[j, j - 1] = h[j] / 6
    want = np.linalg.solve(np.diag(w) + lam * q @ np.linalg.solve(r, q.T), w * pdf.groupby("x").y.mean().loc[x].to_numpy())
    assert np.allclose(got.y.astype(float), want, atol=1e-6)


def test_spline_of_many_and_of_few_points(spark, data):
    pdf, df = data
    line = fit.p_supsmu(df, "y", "x", spar=1.5).toPandas().sort_values("x")  # close to the line
    coef = np.polyfit(line.x, line.y.astype(float), 1)
    assert np.abs(line.y - np.polyval(coef, line.x)).max() < 0.05
    few = fit.p_supsmu(spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 1.0)], "x double, y double"), "y", "x").collect()
    assert [r.y for r in few] == [None, None, None]
