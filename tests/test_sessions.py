"""Play periods, deltas, rate, game clock and summary on hand-written logs."""

import datetime as dt

import pytest

from telespark.operators import sessions, summarize
from telespark.operators.clean import conform

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def _logs(spark, rows):
    data = [(i, T0 + dt.timedelta(seconds=s) if s is not None else None, e, p, c)
            for i, (s, e, p, c) in enumerate(rows)]
    df = spark.createDataFrame(
        data, "RowId long, Timestamp timestamp_ntz, Event string, Participant double, Condition string")
    return conform(df)


def _by_row(df, col):
    return {r.RowId: r[col] for r in df.select("RowId", col).collect()}


def test_play_period_rules(spark):
    rows = [(0, "Sample", 1.0, "A"), (1, "Game Started", 1.0, "A"), (2, "Mole Hit", 1.0, "A"),
            (3, "Game Finished", 1.0, "A"), (4, "Sample", 1.0, "A"), (5, "Game Started", 1.0, "A"),
            # session B: finish without a start is Game, as are rows after it
            (0, "Game Stopped", 1.0, "B"), (1, "Sample", 1.0, "B"),
            # session C: a missing event poisons the rest, finish rows stay Game
            (0, "Game Started", 2.0, "A"), (1, None, 2.0, "A"), (2, "Sample", 2.0, "A"),
            (3, "Game Finished", 2.0, "A")]
    got = _by_row(sessions.play_period(_logs(spark, rows)), "PlayPeriod")
    assert [got[i] for i in range(6)] == ["PreGame", "Game", "Game", "Game", "PostGame", "PostGame"]
    assert [got[6], got[7]] == ["Game", "Game"]
    assert [got[8], got[9], got[10], got[11]] == ["Game", None, None, "Game"]


def test_time_delta_and_null_timestamps(spark):
    rows = [(0, "Sample", 1.0, "A"), (2.5, "Sample", 1.0, "A"), (None, "Sample", 1.0, "A"),
            (7200, "Sample", 1.0, "A")]
    got = _by_row(sessions.time_delta(_logs(spark, rows)), "Time_delta")
    assert got[0] == 0.0 and got[1] == 2.5 and got[2] == 0.0 and got[3] == 7197.5


def test_rate_counts_samples_across_sessions(spark):
    rows = [(0, "Sample", 1.0, "A"), (0.5, "Sample", 2.0, "A"), (0.7, "Mole Hit", 1.0, "A"),
            (1.2, "Sample", 1.0, "A"), (1.5, None, 3.0, "A")]
    got = _by_row(sessions.rate(_logs(spark, rows)), "Hz")
    assert [got[0], got[1], got[2]] == [2, 2, 2]
    assert got[3] is None and got[4] is None


def test_game_clock_null_event_before_start(spark):
    rows = [(0, None, 1.0, "A"), (1, "Game Started", 1.0, "A"), (5, "Game Stopped", 1.0, "A"),
            (0, "Game Started", 2.0, "A"), (1, None, 2.0, "A"), (4, "Game Finished", 2.0, "A"),
            (6, "Game Finished", 2.0, "A")]
    d = sessions.game_clock(_logs(spark, rows)).collect()
    by = {r.RowId: r for r in d}
    assert by[0].GameStarted is None and by[0].GameFinished == T0 + dt.timedelta(seconds=5)
    assert by[3].GameStarted == T0 and by[3].GameFinished == T0 + dt.timedelta(seconds=4)
    assert by[6].GameTimeSpent == 6.0 and by[6].GameTimeLeft == -2.0


def test_summary_one_row_per_finish(spark):
    rows = [(0, "Game Started", 1.0, "A"), (1, "Mole Hit", 1.0, "A"), (3, "Game Stopped", 1.0, "A"),
            (4, "Game Finished", 1.0, "A"),
            (0, "Sample", 2.0, "A"), (3, "Game Finished", 2.0, "A")]       # no start: no row
    prep = sessions.prepare(_logs(spark, rows))
    got = sorted((r.Participant, r.PlayTime, r.MoleHitCount)
                 for r in summarize.session_summary(prep).collect())
    assert got == [(1.0, 3.0, 1), (1.0, 4.0, 1)]


def test_summary_sf001_matches_expected_counts(spark):
    from telespark.plans.registry import QUERIES
    from conftest import SF_MID
    df = QUERIES["session_summary"](spark, SF_MID)
    assert df.count() == 286
    two = df.groupBy("Participant", "Condition").count().filter("count = 2").count()
    assert two == 14


def test_play_period_counts_sf001(spark):
    from telespark.plans.registry import QUERIES
    from conftest import SF_MID
    got = {r.PlayPeriod: r["count"] for r in
           QUERIES["play_period"](spark, SF_MID).groupBy("PlayPeriod").count().collect()}
    assert got == {"Game": 8052, "PreGame": 1113, "PostGame": 506, None: 329}


def test_rate_per_session_keys(spark):
    rows = [(0, "Sample", 1.0, "A"), (0.5, "Sample", 2.0, "A"), (0.7, "Sample", 1.0, "A"),
            (0.2, "Sample", None, "A"), (0.3, "Sample", None, "A")]
    got = _by_row(sessions.rate(_logs(spark, rows), by=("Participant",)), "Hz")
    assert [got[0], got[1], got[2], got[3], got[4]] == [2, 1, 2, 2, 2]
