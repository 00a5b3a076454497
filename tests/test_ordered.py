"""Chunked ordered scans against a pandas brute force."""

import numpy as np
import pandas as pd
import pytest

from telespark.operators import ordered


def _data(seed=0, n=400):
    rng = np.random.default_rng(seed)
    base = pd.Timestamp("2024-01-01")
    ts = [base + pd.Timedelta(seconds=int(s)) for s in rng.integers(0, 4 * 86400, n)]
    df = pd.DataFrame({
        "g": rng.choice(["a", "b", None], n).astype(object),
        "ts": ts,
        "rid": np.arange(n),
        "v": rng.normal(size=n),
        "f": np.where(rng.uniform(size=n) < 0.6, np.nan, rng.integers(0, 5, n)),
    })
    df.loc[rng.choice(n, 15, replace=False), "ts"] = pd.NaT
    df.loc[rng.choice(n, 10, replace=False), "v"] = np.nan
    return df


def _sdf(spark, pdf):
    rows = [(r.g, None if pd.isna(r.ts) else r.ts.to_pydatetime(), int(r.rid),
             None if pd.isna(r.v) else float(r.v), None if pd.isna(r.f) else float(r.f))
            for r in pdf.itertuples()]
    return spark.createDataFrame(rows, "g string, ts timestamp_ntz, rid long, v double, f double")


def _sorted(pdf, keys):
    d = pdf.copy()
    d["_gk"] = d["g"].fillna("<na>") if keys else "all"
    d["_tn"] = d["ts"].isna()
    return d.sort_values(["_gk", "_tn", "ts", "rid"], na_position="last")


@pytest.mark.parametrize("keys,lead", [(("g",), False), (("g",), True), ((), True)])
@pytest.mark.parametrize("unit", ["hour", "day"])
def test_shift(spark, keys, lead, unit):
    pdf = _data()
    got = ordered.shift(_sdf(spark, pdf), keys, "ts", "rid", {"v": "nv"}, lead=lead, unit=unit)
    got = {r.rid: r.nv for r in got.select("rid", "nv").collect()}
    d = _sorted(pdf, keys)
    exp = d.groupby("_gk")["v"].shift(-1 if lead else 1)
    for rid, e in zip(d["rid"], exp):
        g = got[rid]
        assert (g is None and pd.isna(e)) or g == pytest.approx(e)


@pytest.mark.parametrize("strict", [True, False])
def test_running_sum(spark, strict):
    pdf = _data(1)
    got = ordered.running_sum(_sdf(spark, pdf), ("g",), "ts", "rid", "v", "cs", strict=strict)
    got = {r.rid: r.cs for r in got.select("rid", "cs").collect()}
    d = _sorted(pdf, ("g",))
    for _, grp in d.groupby("_gk"):
        acc, dead = 0.0, False
        for rid, v in zip(grp["rid"], grp["v"]):
            if pd.isna(v):
                dead = dead or strict
            else:
                acc += v
            g = got[rid]
            if dead:
                assert g is None
            else:
                assert g == pytest.approx(acc)


def test_fill_down(spark):
    pdf = _data(2)
    got = ordered.fill_down(_sdf(spark, pdf), ("g",), "ts", "rid", "f", "ff", unit="hour")
    got = {r.rid: r.ff for r in got.select("rid", "ff").collect()}
    d = _sorted(pdf, ("g",))
    exp = d.groupby("_gk")["f"].ffill()
    for rid, e in zip(d["rid"], exp):
        g = got[rid]
        assert (g is None and pd.isna(e)) or g == e


@pytest.mark.parametrize("unit", ["hour", "day"])
def test_row_numbers(spark, unit):
    pdf = _data(4)
    got = {r.rid: (r.n, r.total) for r in ordered.row_numbers(_sdf(spark, pdf), ("g",), "ts", "rid", "n", "total", unit=unit).collect()}
    d = _sorted(pdf, ("g",))
    want = {int(i): (int(n) + 1, int(t)) for i, n, t in zip(d.rid, d.groupby("_gk").cumcount(), d.groupby("_gk")["rid"].transform("size"))}
    assert got == want


def test_a_user_with_half_of_the_rows_is_many_tasks(spark):
    """Rows that the largest task of the telemetry view and of the session pass holds."""
    from pyspark.sql import functions as F

    from telespark.operators.clean import conform
    from telespark.operators.sessions import session_pass
    from telespark.sources.telemetry import telemetry_from_events

    n = 20_000
    events = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_add("SECOND", F.col("id") * 120, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("ts"),
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 997).cast("long").alias("user_id"), F.lit("view").alias("event_type"),
        F.lit(1.0).alias("value"), F.lit('{"k": 7}').alias("props"))
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(was, ("64", "false", "-1")):
        spark.conf.set(k, v)
    try:
        view = telemetry_from_events(events)
        for df in (view, session_pass(conform(view))):
            used = df.select(F.spark_partition_id().alias("p"), F.hash(*df.columns).cast("long").alias("h"))  # no column is pruned
            sizes = [r["n"] for r in used.groupBy("p").agg(F.count("*").alias("n"), F.sum("h")).collect()]
            assert sum(sizes) == n and max(sizes) < n / 8
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
