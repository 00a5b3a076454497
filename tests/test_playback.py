"""Playback at second ticks on hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from telespark.operators import animate
from telespark.operators.clean import conform
from telespark.operators.sessions import prepare

START = dt.datetime(2024, 1, 1, 10, 0, 0)


def table(spark, rows):
    """rows: (participant, seconds after START or None, event, target, x, laser x)"""
    data = [(i, None if s is None else START + dt.timedelta(seconds=s), e, p, "A", m, x, 0.5 if x is not None else None, lx, 1.0)
            for i, (p, s, e, m, x, lx) in enumerate(rows)]
    schema = ("RowId long, Timestamp timestamp_ntz, Event string, Participant double, Condition string, MoleId string, MolePositionWorldX double, "
              "MolePositionWorldY double, RightControllerLaserPosWorldX double, RightControllerLaserPosWorldY double")
    return prepare(conform(spark.createDataFrame(data, schema)))


ROWS = [
    (1.0, -3.2, "Mole Spawned", "01", 1.0, 9.0),    # before the start: carried into the grid
    (1.0, 0.0, "Game Started", None, None, 0.1),
    (1.0, 2.1, "Mole Hit", "01", 1.5, 0.2),          # two events in one tick: the later one counts
    (1.0, 2.7, "Mole Spawned", "01", 2.0, 0.3),
    (1.0, 2.9, "Sample", None, None, 0.4),
    (1.0, 4.0, "Mole Spawned", "02", 3.0, 0.5),
    (1.0, 4.5, "Mole Expired", "01", 2.0, 0.6),
    (1.0, 6.4, "Game Finished", None, None, 0.7),
    (1.0, 8.2, "Game Stopped", None, None, 0.8),     # two finishes: the playback runs to the last
    (1.0, None, "Mole Spawned", "02", 3.0, 0.9),     # no time: after everything else
    (2.0, 1.0, "Game Started", None, None, 0.1),     # no target, no finish: no playback
]


@pytest.fixture(scope="module")
def prep(spark):
    return table(spark, ROWS)


def test_targets_hold_their_size_between_events(prep):
    got = animate.densify(prep).filter("name = 'Active Mole' AND second IS NOT NULL").collect()
    one = sorted((r.second, r.size, r.Event, r.x) for r in got if r.id == "01")
    assert one == [
        (-4.0, 1.0, "Mole Spawned", 1.0), (0.0, 1.0, None, 1.0), (1.0, 1.0, None, 1.0), (2.0, 0.0, "Mole Hit", 1.5), (2.0, 1.0, "Mole Spawned", 2.0),
        (3.0, 1.0, None, 1.0), (4.0, 0.0, "Mole Expired", 2.0), (5.0, 0.0, None, 1.0), (6.0, 0.0, None, 1.0), (7.0, 0.0, None, 1.0), (8.0, 0.0, None, 1.0)]
    two = sorted((r.second, r.size, r.Event) for r in got if r.id == "02")
    assert two == [(0.0, 0.0, None), (1.0, 0.0, None), (2.0, 0.0, None), (3.0, 0.0, None), (4.0, 1.0, "Mole Spawned"),
                   (5.0, 1.0, None), (6.0, 1.0, None), (7.0, 1.0, None), (8.0, 1.0, None)]
    assert {r.Participant for r in got} == {1.0}


def test_lower_bound_drops_what_comes_before_the_start(prep):
    assert min(r.second for r in animate.densify(prep, lower=0.0).collect()) == 0.0


def test_laser_per_tick(prep):
    got = {r.second: (r.has_hit, r.x, r.size) for r in animate.densify(prep).filter("name = 'Laser'").collect()}
    assert got == {0.0: (False, 0.1, 1.0), 1.0: (None, None, 0.0), 2.0: (True, 0.2, 1.0), 3.0: (None, None, 0.0), 4.0: (False, 0.6, 1.0),
                   5.0: (None, None, 0.0), 6.0: (False, 0.7, 1.0), 7.0: (None, None, 0.0), 8.0: (False, 0.8, 1.0)}


def test_long_spans_are_cut_into_blocks(spark, monkeypatch, prep):
    want = sorted(map(repr, animate.densify(prep).collect()))
    monkeypatch.setattr(animate, "TICK_BLOCK", 2)
    assert sorted(map(repr, animate.densify(prep).collect())) == want


@pytest.mark.parametrize("ticks", [1, 2, 3])
def test_chunks_hand_their_size_on(spark, monkeypatch, ticks):
    """Chunks without real rows, and rows more than a chunk before the start, keep what came before them."""
    rows = [*ROWS, (3.0, -9.0, "Mole Spawned", "01", 1.0, 0.1), (3.0, -7.5, "Mole Hit", "02", 2.0, 0.1), (3.0, -7.0, "Mole Spawned", "02", 2.0, 0.1),
            (3.0, 0.0, "Game Started", None, None, 0.1), (3.0, 7.2, "Mole Hit", "01", 1.0, 0.2), (3.0, 12.0, "Mole Spawned", "01", 1.0, 0.3),
            (3.0, 11.0, "Game Finished", None, None, 0.4), (None, 0.0, "Game Started", None, None, 0.1), (None, 1.0, "Mole Spawned", "03", 1.0, 0.1),
            (None, 5.0, "Game Stopped", None, None, 0.1)]
    more = table(spark, rows)
    want = sorted(map(repr, animate.densify(more).collect()))
    monkeypatch.setattr(animate, "TICK_CHUNK", ticks)
    assert sorted(map(repr, animate.densify(more).collect())) == want
    got = {(r.second, r.id): r.size for r in animate.densify(more, lower=0.0).filter("Participant = 3 AND name = 'Active Mole'").collect()}
    assert got == {**{(float(t), "01"): float(t < 7) for t in range(12)}, **{(float(t), "02"): 1.0 for t in range(12)}}


def test_real_ticks_and_their_entities_come_together_once(prep):
    """No table of the entities' chunks is as long as the events: an entity's row and its real ticks are one shuffle, without a join."""
    extent = animate.playback_extent(prep)
    lasers = animate._with_extent(animate.laser_per_second(prep), extent, ["Participant", "Condition"]).withColumn("size", F.lit(0.0)).localCheckpoint()
    ent = animate._entities(extent, animate.laser_template(prep), ["Participant", "Condition"]).localCheckpoint()
    plan = animate._free_runs(lasers, ent, ["Participant", "Condition"], "second")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 3


def test_nothing_is_shuffled_above_the_generated_ticks(prep):
    plan = animate.filled_targets(prep)._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Generate explode(sequence(_lo")]
    assert "Exchange" not in top.split("Union")[-1]


@pytest.mark.parametrize("build", [animate.filled_targets, animate.free_spine, animate.densify, animate.anim_frames])
def test_ticks_are_many_tasks_and_cost_no_time_function(prep, build):
    """Runs are few bytes and many ticks: their tasks are never joined by size, and a tick is a step, not a sum of times."""
    plan = build(prep)._jdf.queryExecution().executedPlan().toString()
    blocks = [line for line in plan.splitlines() if "Exchange" in line and "REPARTITION_BY" in line]
    assert blocks and all("REPARTITION_BY_NUM" in line for line in blocks)
    lines = plan.splitlines()
    for at in (k for k, line in enumerate(lines) if "Generate explode(sequence(_lo" in line):
        while "Project" in lines[at := at - 1] or "Filter" in lines[at]:
            assert "timestampadd" not in lines[at].split("sequence(")[0] or "AS _lo" in lines[at]
            assert "timestampdiff" not in lines[at]


@pytest.mark.parametrize("build", [animate.densify, lambda d: animate.densify(d, lower=0.0)])
def test_no_union_stands_above_the_generated_ticks(prep, build):
    """Both layers' free and real rows are generated in one place: what reads a tick runs where it is generated."""
    plan = build(prep)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(sequence(_lo") == 1
    assert "Union" not in plan[: plan.index("Generate explode(sequence(_lo")]


def test_rows_of_a_crowded_tick_are_dealt_out(prep):
    """Real rows of one tick are not one task: their load order is part of what deals them out."""
    plan = animate.densify(prep)._jdf.queryExecution().executedPlan().toString()
    (blocks,) = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert "_tie" in blocks


def test_a_layer_is_built_without_the_other(prep):
    lasers = animate.anim_layers(animate.densify(prep))[1]._jdf.queryExecution().executedPlan().toString()
    assert "Mole Expired" not in lasers and lasers.count("Generate explode(sequence(_lo") == 1


def test_untimed_rows_stay_without_a_horizon(prep):
    assert [r.id for r in animate.densify(prep, horizon=False).collect() if r.second is None] == ["02"]
    assert [(r.id, r.size) for r in animate.filled_targets(prep).collect() if r.second is None] == [("02", 1.0)]


def test_axis_range_leaves_out_what_is_not_a_number(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (float("nan"), 2.0), (3.0, None)], "MolePositionWorldX double, MolePositionWorldY double")
    assert tuple(animate.axis_range(df).first()) == (0.0, 4.0, 1.0, 3.0)
