"""Telemetry view: the driver's ``events`` table shaped as game logs.

Each user is one participant, split into two conditions by date; each
(participant, condition) is one session.  Events are mapped onto the game's
event vocabulary with deliberate edge cases: sessions without a start, with
two finish markers, without a finish, a missing event, missing positions and
missing gaze values.  The same mapping is written in SQL in
``telespark.plans.oracle.TELEMETRY_SQL`` for the DuckDB cross-check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telespark.operators import ordered
from telespark.sources.tables import read_table

# The date splitting the two conditions and the condition names.
CONDITION_SPLIT = "2024-01-16 00:00:00"
CONDITIONS = ("CondA", "CondB")


def telemetry_from_events(events: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    cond = F.when(F.col("ts") < F.lit(CONDITION_SPLIT).cast("timestamp_ntz"),
                  F.lit(CONDITIONS[0])).otherwise(F.lit(CONDITIONS[1]))
    b = events.select("event_id", "ts", "user_id", "event_type", "value",
                      k.alias("k"), cond.alias("cond"))
    # In day chunks: a user who holds a large share of the rows is many tasks.
    b = ordered.row_numbers(b, ["user_id", "cond"], "ts", "event_id", "rn", "cnt", unit="day")
    u, rn, cnt = F.col("user_id"), F.col("rn"), F.col("cnt")
    ev = (F.when((u % 23 == 5) & (rn == 7), F.lit(None).cast("string"))
          .when((rn == 3) & (u % 17 != 4), "Game Started")
          .when((rn == cnt - 2) & (u % 2 == 0), "Game Finished")
          .when((rn == cnt - 2) & (u % 2 == 1) & (u % 13 != 3), "Game Stopped")
          .when((rn == cnt - 1) & (u % 19 == 2), "Game Stopped")
          .when(F.col("event_type") == "view", "Mole Spawned")
          .when(F.col("event_type") == "click", "Mole Hit")
          .when(F.col("event_type") == "purchase", "Mole Expired")
          .otherwise("Sample"))
    e = b.withColumn("ev", ev)
    mole = F.col("ev").like("Mole %")
    kk = F.col("k")
    pos = mole & (kk != 50)
    return e.select(
        F.col("event_id").alias("RowId"),
        F.col("ts").alias("Timestamp"),
        F.col("ev").alias("Event"),
        u.cast("double").alias("Participant"),
        F.col("cond").alias("Condition"),
        F.concat(F.lit("S"), u.cast("string"), F.col("cond")).alias("SessionID"),
        F.col("event_id").cast("double").alias("Framecount"),
        F.when(mole, F.concat(F.lpad((kk % 9 + 1).cast("string"), 2, "0"),
                              F.lpad((kk % 5 + 1).cast("string"), 2, "0"))).alias("MoleId"),
        F.when(pos, (kk % 9 - 4).cast("double")).alias("MolePositionWorldX"),
        F.when(pos, (kk % 5) * F.lit(0.5).cast("double")).alias("MolePositionWorldY"),
        F.when(mole, rn.cast("string")).alias("MoleSpawnOrder"),
        F.when(mole, F.substring(F.lit("ABCD"), (kk % 4 + 1), 1)).alias("PatternSegmentLabel"),
        F.when(kk % 10 != 0, F.col("value")).alias("WorldGazeHitPositionX"),
        F.when(u % 29 != 1, kk.cast("double") / 100).alias("GazeConfidence"),
        (F.col("value") / 100 - F.lit(0.5)).alias("RightControllerLaserPosWorldX"),
        (F.col("value") / 50).alias("RightControllerLaserPosWorldY"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_from_events(read_table(spark, sf_dir, "events"))
