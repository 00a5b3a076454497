"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each string runs on DuckDB with the driver tables registered as views.  The
telemetry view and the prepared table are common table expressions, so every
oracle query starts from ``events`` exactly as the Spark plan does.
"""

from __future__ import annotations

TELEMETRY_SQL = """
b AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k,
         CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'CondA' ELSE 'CondB' END AS cond
  FROM events),
n AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, cond ORDER BY ts, event_id) AS rn,
            count(*)     OVER (PARTITION BY user_id, cond) AS cnt FROM b),
e AS (
  SELECT *, CASE
    WHEN user_id % 23 = 5 AND rn = 7 THEN NULL
    WHEN rn = 3 AND user_id % 17 <> 4 THEN 'Game Started'
    WHEN rn = cnt - 2 AND user_id % 2 = 0 THEN 'Game Finished'
    WHEN rn = cnt - 2 AND user_id % 2 = 1 AND user_id % 13 <> 3 THEN 'Game Stopped'
    WHEN rn = cnt - 1 AND user_id % 19 = 2 THEN 'Game Stopped'
    WHEN event_type = 'view' THEN 'Mole Spawned'
    WHEN event_type = 'click' THEN 'Mole Hit'
    WHEN event_type = 'purchase' THEN 'Mole Expired'
    ELSE 'Sample' END AS ev FROM n),
telemetry AS (
SELECT event_id AS RowId, ts AS Timestamp, ev AS Event,
  CAST(user_id AS DOUBLE) AS Participant, cond AS Condition,
  'S' || CAST(user_id AS VARCHAR) || cond AS SessionID,
  CAST(event_id AS DOUBLE) AS Framecount,
  CASE WHEN ev LIKE 'Mole %' THEN lpad(CAST(k % 9 + 1 AS VARCHAR), 2, '0') || lpad(CAST(k % 5 + 1 AS VARCHAR), 2, '0') END AS MoleId,
  CASE WHEN ev LIKE 'Mole %' AND k <> 50 THEN CAST(k % 9 - 4 AS DOUBLE) END AS MolePositionWorldX,
  CASE WHEN ev LIKE 'Mole %' AND k <> 50 THEN (k % 5) * CAST(0.5 AS DOUBLE) END AS MolePositionWorldY,
  CASE WHEN ev LIKE 'Mole %' THEN CAST(rn AS VARCHAR) END AS MoleSpawnOrder,
  CASE WHEN ev LIKE 'Mole %' THEN substr('ABCD', k % 4 + 1, 1) END AS PatternSegmentLabel,
  CASE WHEN k % 10 <> 0 THEN value END AS WorldGazeHitPositionX,
  CASE WHEN user_id % 29 <> 1 THEN CAST(k AS DOUBLE) / 100 END AS GazeConfidence,
  value / 100 - CAST(0.5 AS DOUBLE) AS RightControllerLaserPosWorldX,
  value / 50 AS RightControllerLaserPosWorldY
FROM e)"""


def delta(a: str, b: str) -> str:
    """Seconds from a to b, exact to the microsecond."""
    return f"CAST(date_diff('microsecond', {a}, {b}) AS DOUBLE) / 1e6"


SESSION = "PARTITION BY Participant, Condition"
ORDER = "ORDER BY Timestamp ASC NULLS LAST, RowId"


def prep_sql(rate_unit: str = "second") -> str:
    """CTEs ``telemetry`` .. ``prep``: the prepared table."""
    return TELEMETRY_SQL + f""",
m AS (SELECT *,
   CASE WHEN Event IS NULL THEN NULL
        WHEN Event IN ('Game Started', 'Game Finished', 'Game Stopped') THEN 1 ELSE 0 END AS mk,
   coalesce(Event IN ('Game Finished', 'Game Stopped'), false) AS fin,
   row_number() OVER ({SESSION} {ORDER}) AS pos
 FROM telemetry),
c AS (SELECT *,
   CASE WHEN max(CASE WHEN mk IS NULL THEN 1 ELSE 0 END) OVER w = 1 THEN NULL ELSE sum(mk) OVER w END AS cs,
   lag(Timestamp) OVER ({SESSION} {ORDER}) AS prev,
   min(CASE WHEN Event = 'Game Started' THEN pos END) OVER s AS fs,
   min(CASE WHEN Event IS NULL THEN pos END) OVER s AS fu,
   min(CASE WHEN Event = 'Game Started' THEN Timestamp END) OVER s AS ts_start,
   min(CASE WHEN fin THEN Timestamp END) OVER s AS GameFinished
 FROM m
 WINDOW w AS ({SESSION} {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        s AS ({SESSION})),
p AS (SELECT *, CASE WHEN fin THEN 1 ELSE cs END AS ind,
   CASE WHEN fs IS NOT NULL AND (fu IS NULL OR fu > fs) THEN ts_start END AS GameStarted
 FROM c),
prep AS (SELECT RowId, Timestamp, Event, Participant, Condition, SessionID, Framecount, MoleId,
   MolePositionWorldX, MolePositionWorldY, MoleSpawnOrder, PatternSegmentLabel,
   WorldGazeHitPositionX, GazeConfidence, RightControllerLaserPosWorldX, RightControllerLaserPosWorldY,
   CASE WHEN ind < 1 THEN 'PreGame' WHEN ind > 1 THEN 'PostGame' WHEN ind = 1 THEN 'Game' END AS PlayPeriod,
   coalesce({delta('prev', 'Timestamp')}, CAST(0 AS DOUBLE)) AS Time_delta,
   GameStarted, GameFinished,
   {delta('GameStarted', 'Timestamp')} AS GameTimeSpent,
   {delta('Timestamp', 'GameFinished')} AS GameTimeLeft,
   CASE WHEN max(CASE WHEN Event IS NULL THEN 1 ELSE 0 END) OVER h = 1 THEN NULL
        ELSE CAST(sum(CASE WHEN Event = 'Sample' THEN 1 ELSE 0 END) OVER h AS BIGINT) END AS Hz
 FROM p
 WINDOW h AS (PARTITION BY date_trunc('{rate_unit}', Timestamp)))"""


def with_prep(body: str, rate_unit: str = "second") -> str:
    return "WITH " + prep_sql(rate_unit) + "\n" + body


def with_telemetry(body: str) -> str:
    return "WITH " + TELEMETRY_SQL + "\n" + body
