"""Data-cut chunks, as-of and existence joins, clustered files and sorted playback."""

import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from telespark.operators import animate, asof, existence, fit, ordered, spatial
from telespark.plans.registry import prepared, typed
from telespark.session import written
from telespark.sources import sinks


# ---------------------------------------------------------------- chunks cut by the data

@pytest.fixture(scope="module")
def crowded(spark):
    """Spawns that nearly all fall into one second."""
    rng = random.Random(1)
    rows = [(float(i % 5), "c", "2024-01-01 10:00:01", i, float(rng.randint(0, 3)), float(rng.randint(0, 3))) for i in range(2000)]
    rows += [(1.0, "c", None, 3000 + i, 1.0, 2.0) for i in range(5)]
    return spark.createDataFrame(rows, "Participant double, Condition string, t string, RowId long, MolePositionWorldX double, MolePositionWorldY double").select(
        "*", F.col("t").cast("timestamp_ntz").alias("Timestamp")).drop("t").repartition(4).cache()


def test_one_second_is_many_chunks(crowded):
    d = ordered.range_chunks(crowded, (), [F.col("Timestamp").asc_nulls_last(), F.col("RowId")], rows=100)
    sizes = [r["count"] for r in d.groupBy(ordered.CHUNK).count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 400
    spans = d.groupBy(ordered.CHUNK).agg(F.min("RowId"), F.max("RowId")).orderBy(ordered.CHUNK).collect()
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("scope", ["global", "session"])
def test_direction_does_not_depend_on_the_chunks(crowded, scope):
    cols = ["RowId", "travelLeadHor", "travelLeadVer"]
    one = sorted(map(tuple, spatial.travel_direction(crowded, scope=scope).select(*cols).collect()))
    many = sorted(map(tuple, spatial.travel_direction(crowded, scope=scope, rows=90).select(*cols).collect()))
    assert one == many
    if scope == "global":
        xy = {r.RowId: (r.MolePositionWorldX, r.MolePositionWorldY) for r in crowded.collect()}
        ids = sorted(xy)
        for a, (hor, ver) in zip(ids, [m[1:] for m in many]):
            nxt = xy.get(ids[ids.index(a) + 1]) if a != ids[-1] else None
            want = None if nxt is None else ("None" if xy[a][0] == nxt[0] else "Right" if xy[a][0] > nxt[0] else "Left")
            assert hor == want


def test_spline_does_not_depend_on_the_chunks(spark):
    rng = random.Random(2)
    rows = [("long", i / 7.0, math.sin(i / 300) + rng.gauss(0, 0.2)) for i in range(3000)] + [("short", float(i), float(i * i)) for i in range(9)] + [("few", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "s string, x double, y double")
    one, _ = fit.spline_points(df, "y", "x", ["s"])
    many, _ = fit.spline_points(df, "y", "x", ["s"], rows=70)
    cols = [c for c in one.columns if not c.startswith("b")]
    assert sorted(map(str, one.select(*cols).collect())) == sorted(map(str, many.select(*cols).collect()))


# ---------------------------------------------------------------- as-of join

@pytest.mark.parametrize("rows", [None, 40])
def test_ceiling_join(spark, rows):
    rng = random.Random(3)
    levels = [(rng.choice([round(rng.random(), 2), 0.5]), f"c{i}", i) for i in range(150)] + [(None, "none", 200), (float("nan"), "nan", 201)]
    values = [(i, rng.choice([0.5, 0.5, rng.random() * 1.2, None, float("nan"), -1.0, float("-inf"), float("inf")])) for i in range(900)]
    values += values[:20]
    df = spark.createDataFrame(values, "id long, x double").repartition(3)
    table = spark.createDataFrame(levels, "level double, color string, place long")
    got = asof.ceiling_join(df, "x", table, "level", ["color"], tie="id", first="place", rows=rows)
    assert got.columns == ["id", "x", "color"]
    known = [lv for lv in levels if lv[0] is not None and not math.isnan(lv[0])]

    def want(x):
        if x is None or math.isnan(x):
            return None
        above = [lv for lv in known if lv[0] >= x]
        return min(above, key=lambda lv: (lv[0], lv[2]))[1] if above else None

    assert sorted(map(repr, [tuple(r) for r in got.collect()])) == sorted(map(repr, [(i, x, want(x)) for i, x in values]))


def test_ceiling_join_of_nothing(spark):
    empty = spark.createDataFrame([], "level double, color string")
    df = spark.createDataFrame([(1, 0.5)], "id long, x double")
    assert [tuple(r) for r in asof.ceiling_join(df, "x", empty, "level", ["color"], tie="id").collect()] == [(1, 0.5, None)]
    assert asof.ceiling_join(df.limit(0), "x", spark.createDataFrame([(1.0, "a")], "level double, color string"), "level", ["color"], tie="id").collect() == []


# ---------------------------------------------------------------- existence join

@pytest.mark.parametrize("few", [10_000, 0])
def test_flag_from_a_table(spark, monkeypatch, few):
    monkeypatch.setattr(existence, "FEW", few)
    values = spark.range(0, 3000, 3).select(F.concat(F.lit("v"), "id").alias("v")).unionByName(spark.createDataFrame([("v0",), (None,)], "v string"))
    df = spark.range(0, 4000).select("id", F.when(F.col("id") % 10 != 7, F.concat(F.lit("v"), "id")).alias("m")).repartition(3)
    got = {r.id: r.measured for r in spatial.in_set_flag(df, "m", values).collect()}
    assert got == {i: i % 10 != 7 and i < 3000 and i % 3 == 0 for i in range(4000)}


def test_filter_refuses_most_absent_values(spark):
    known = spark.range(2000).select(F.col("id").cast("string").alias("v"))
    bits = 32768
    maps = existence.bloom_filter(known, bits).collect()
    assert len(maps) == 1
    on = {8 * i + j for i, byte in enumerate(bytes(maps[0].bitmap)) for j in range(8) if byte >> j & 1}
    at = [F.pmod(F.xxhash64("v", F.lit(s)), F.lit(bits)).alias(f"p{s}") for s in range(existence.HASHES)]
    ask = spark.range(4000).select(F.col("id").cast("string").alias("v")).select(*at).collect()
    hits = [all(p in on for p in r) for r in ask]
    assert all(hits[:2000]) and sum(hits[2000:]) / 2000 < 2 * existence.false_positive_rate(2000, bits) + 0.01


def test_empty_value_table(spark, monkeypatch):
    df = spark.createDataFrame([("a",), (None,)], "m string")
    none = spark.createDataFrame([], "v string")
    assert [r.measured for r in spatial.in_set_flag(df, "m", none).collect()] == [False, False]


# ---------------------------------------------------------------- clustered files

def test_a_session_reads_its_files_only(spark, tmp_path):
    prep = prepared(spark, SF_SMALL).select("Participant", "Condition", "Timestamp", "RowId", "Event").unionByName(
        spark.createDataFrame([(None, "CondA", None, -1, "Sample")], "Participant double, Condition string, Timestamp timestamp_ntz, RowId long, Event string"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        schema = sinks.write_clean(prep, str(tmp_path), file_rows=60)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    rows = sorted(map(str, prep.collect()))
    assert sorted(map(str, sinks.read_clean(spark, str(tmp_path), schema).collect())) == rows
    index = spark.read.parquet(f"{tmp_path}/index").collect()
    sessions = prep.select("Participant", "Condition").distinct().count()
    assert len(index) < sessions and sum(r.rows for r in index) == len(rows) and max(r.rows for r in index) <= 60
    for wanted in ({"Participant": 5.0, "Condition": "CondB"}, {"Participant": 3.0}, {"Participant": None, "Condition": "CondA"}):
        files = sinks.clean_files(spark, str(tmp_path), wanted)
        assert 1 <= len(files) <= 4 < len(index)
        got = sinks.read_clean(spark, str(tmp_path), schema, wanted)
        want = prep
        for c, v in wanted.items():
            want = want.where(F.col(c).eqNullSafe(F.lit(v)))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
        assert {f.rsplit("/", 1)[1] for f in got.inputFiles()} == {f.rsplit("/", 1)[1] for f in files}
    assert sinks.read_clean(spark, str(tmp_path), schema, {"Participant": 1e9}).collect() == []


def test_few_rows_are_one_file(spark, tmp_path):
    sinks.write_clean(prepared(spark, SF_SMALL).select("Participant", "Condition", "Timestamp", "RowId"), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/index").count() == 1


# ---------------------------------------------------------------- sorted playback

def test_sorted_playback_is_the_playback_in_order(spark, monkeypatch):
    monkeypatch.setattr(animate, "SORTED_BLOCK", 7)
    prep = written(prepared(spark, SF_SMALL).where("Participant < 4"), "prep")
    cols = ["Participant", "Condition", "second", "id", "name", "x", "y", "size", "Event", "has_hit"]
    d = animate.sorted_playback(prep, unit="hour").select(*cols)
    rows = d.collect()
    assert sorted(map(str, rows)) == sorted(map(str, animate.densify(prep, unit="hour").select(*cols).collect())) and rows
    order = [(r.Participant, r.Condition, r.second, r.id) for r in rows]
    assert order == sorted(order)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and plan.index("Generate") < plan.index("Sort [")
    late = animate.sorted_playback(prep, unit="hour", lower=0.0).select(*cols).collect()
    assert list(map(str, late)) == [str(r) for r in rows if r.second >= 0] and len(late) < len(rows)


def test_free_spine_is_the_grid_without_real_ticks(spark):
    d = typed(spark, SF_SMALL).where("Participant < 4").cache()
    grid = animate.time_grid(animate.playback_extent(d, unit="hour"), unit="hour", entities=animate.mole_template(d).unionByName(animate.laser_template(d)))
    real = {(r.Participant, r.Condition, r.second, r.id) for r in animate.mole_activity(d, unit="hour").collect()}
    cols = ["Participant", "Condition", "second", "id", "x", "y", "size", "name"]
    want = [str(r) for r in grid.select(*cols).collect() if (r.Participant, r.Condition, r.second, r.id) not in real]
    assert sorted(map(str, animate.free_spine(d, unit="hour").select(*cols).collect())) == sorted(want)
