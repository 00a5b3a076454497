"""Session preparation: play periods, row durations, sample rate, game clock.

Input is the typed log table (one row per logged event or sample) with the
session keys, a timestamp and a load-order tie-breaker.  Every step is a lazy
DataFrame transformation; ordered steps use the chunked scans from
:mod:`telespark.operators.ordered`, un-ordered group values are partial
aggregates joined back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telespark.functions.nulls import in_set
from telespark.functions.time import duration_seconds, unit_chunk
from telespark.operators import ordered
from telespark.operators.ordered import drop_scan_keys, order_key

# The game's marker events.
GAME_STARTED = "Game Started"
GAME_FINISHED = "Game Finished"
GAME_STOPPED = "Game Stopped"
FINISH_EVENTS = (GAME_FINISHED, GAME_STOPPED)
SAMPLE = "Sample"
MOLE_SPAWNED = "Mole Spawned"
MOLE_HIT = "Mole Hit"
MOLE_EXPIRED = "Mole Expired"


@dataclass(frozen=True)
class SessionSpec:
    """Column roles.  ``keys`` identify a session; rows are ordered by
    ``(ts NULLS LAST, tie)``; ``unit`` is the chunk size of ordered scans."""
    keys: Sequence[str] = ("Participant", "Condition")
    ts: str = "Timestamp"
    tie: str = "RowId"
    event: str = "Event"
    unit: str = "hour"


DEFAULT = SessionSpec()


def _finish(spec: SessionSpec):
    return in_set(spec.event, FINISH_EVENTS)


def play_period(df: DataFrame, spec: SessionSpec = DEFAULT) -> DataFrame:
    """``PlayPeriod``: PreGame / Game / PostGame from the running marker count.

    Markers (start, finish, stop) count 1; finish rows are forced to 1; a
    running count < 1 is PreGame, = 1 Game, > 1 PostGame.  A missing event
    makes the count unknown for the rest of the session (R's ``cumsum``), so
    those rows get no period, except finish rows.
    """
    ev = F.col(spec.event)
    mk = F.when(ev.isNull(), F.lit(None).cast("int")) \
        .when(ev.isin(GAME_STARTED, *FINISH_EVENTS), 1).otherwise(0)
    d = df.withColumn("_mk", mk)
    d = ordered.running_sum(d, spec.keys, spec.ts, spec.tie, "_mk", "_ind",
                            strict=True, unit=spec.unit)
    ind = F.when(_finish(spec), F.lit(1)).otherwise(F.col("_ind"))
    period = (F.when(ind < 1, "PreGame").when(ind > 1, "PostGame")
              .when(ind == 1, "Game"))
    return d.withColumn("PlayPeriod", period).drop("_mk", "_ind")


def time_delta(df: DataFrame, spec: SessionSpec = DEFAULT) -> DataFrame:
    """``Time_delta``: seconds since the previous row of the session, 0 for the
    first row (and whenever a timestamp is missing)."""
    d = ordered.shift(df, spec.keys, spec.ts, spec.tie, {spec.ts: "_prev"}, unit=spec.unit)
    delta = F.coalesce(duration_seconds("_prev", spec.ts), F.lit(0.0))
    return d.withColumn("Time_delta", delta).drop("_prev")


def rate(df: DataFrame, spec: SessionSpec = DEFAULT, unit: str = "second",
         by: Sequence[str] = (), out: str = "Hz") -> DataFrame:
    """``Hz``: number of Sample rows in the same wall-clock ``unit``, counted
    over all sessions together unless ``by`` names keys; unknown (null) when
    that bucket holds a row with a missing event.

    A partial aggregate per bucket is joined back; a bucket holding a large
    share of the rows is split by AQE's skew-join handling instead of landing
    in one window task.
    """
    ev = F.col(spec.event)
    bucket = "_bucket"
    d = df.withColumn(bucket, unit_chunk(spec.ts, unit))
    keys = [*by, bucket]
    counts = (d.groupBy(*keys)
              .agg(F.sum(F.when(ev == SAMPLE, 1).otherwise(0)).alias("_n"),
                   F.max(ev.isNull().cast("int")).alias("_u"))
              .select(*keys, F.when(F.col("_u") == 1, F.lit(None))
                      .otherwise(F.col("_n")).cast("long").alias(out)))
    if by:
        on = [d[c].eqNullSafe(counts[c]) for c in by] + [d[bucket] == counts[bucket]]
        j = d.join(counts, on, "left").drop(*[counts[c] for c in keys])
    else:
        j = d.join(counts, bucket, "left")
    return j.drop(bucket)


def game_clock(df: DataFrame, spec: SessionSpec = DEFAULT) -> DataFrame:
    """``GameStarted``/``GameFinished`` per session and the seconds since
    start (``GameTimeSpent``, recomputed) and until finish (``GameTimeLeft``).

    GameStarted is the first start marker, but null when a row with a missing
    event comes before it (R pastes the subset ``Timestamp[Event == ...]``,
    whose NA entries make the parse fail).  GameFinished is the first finish
    or stop marker.
    """
    ev = F.col(spec.event)
    ok = order_key(spec.ts, spec.tie)
    d = ordered.group_min(df, spec.keys, spec.ts, {
        "_s": F.when(ev == GAME_STARTED, ok),
        "_u": F.when(ev.isNull(), ok),
        "_f": F.when(_finish(spec), ok),
    }, unit=spec.unit)
    start = F.when(F.col("_u").isNull() | (F.col("_u") > F.col("_s")), F.col("_s.t"))
    d = d.withColumns({"GameStarted": start, "GameFinished": F.col("_f.t")})
    d = d.withColumns({
        "GameTimeSpent": duration_seconds("GameStarted", spec.ts),
        "GameTimeLeft": duration_seconds(spec.ts, "GameFinished"),
    })
    return d.drop("_s", "_u", "_f")


def session_pass(df: DataFrame, spec: SessionSpec = DEFAULT) -> DataFrame:
    """Play period, time delta and game clock in one fused pass.

    One window over ``(session, chunk)`` computes the in-chunk running
    marker count, its poison flag and the previous timestamp; one chunk table
    (built from the input, so nothing upstream is recomputed) carries the
    totals before each chunk, the last timestamp of the previous chunk and
    the session's first start / missing event / finish; one join brings it
    back.  Results equal :func:`play_period`, :func:`time_delta` and
    :func:`game_clock` applied in turn.
    """
    ev, ts = F.col(spec.event), F.col(spec.ts)
    mk = F.when(ev.isNull(), F.lit(None).cast("int")) \
        .when(ev.isin(GAME_STARTED, *FINISH_EVENTS), 1).otherwise(0)
    base = ordered.with_scan_keys(df, spec.keys, spec.ts, spec.unit).withColumn("_mk", mk)
    w = Window.partitionBy(ordered.KEY, ordered.CHUNK).orderBy(ts.asc_nulls_last(), F.col(spec.tie))
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = base.withColumns({
        "_ls": F.sum("_mk").over(run),
        "_ln": F.max(F.col("_mk").isNull().cast("int")).over(run),
        "_prev": F.lag(ts).over(w),
        "_edge": F.lag(F.lit(1)).over(w).isNull(),
    })
    ok = order_key(spec.ts, spec.tie)
    wc = Window.partitionBy(ordered.KEY).orderBy(ordered.CHUNK)
    before = wc.rowsBetween(Window.unboundedPreceding, -1)
    grp = Window.partitionBy(ordered.KEY)
    chunks = (base.groupBy(ordered.KEY, ordered.CHUNK).agg(
        F.coalesce(F.sum("_mk"), F.lit(0)).alias("_t"),
        F.max(F.col("_mk").isNull().cast("int")).alias("_n"),
        F.max_by(ts, ok).alias("_last"),
        F.min(F.when(ev == GAME_STARTED, ok)).alias("_s"),
        F.min(F.when(ev.isNull(), ok)).alias("_u"),
        F.min(F.when(_finish(spec), ok)).alias("_f"))
        .withColumns({
            "_ps": F.coalesce(F.sum("_t").over(before), F.lit(0)),
            "_pn": F.coalesce(F.max("_n").over(before), F.lit(0)),
            "_pts": F.lag("_last").over(wc),
            "_s": F.min("_s").over(grp), "_u": F.min("_u").over(grp), "_f": F.min("_f").over(grp)})
        .drop("_t", "_n", "_last"))
    d = d.join(chunks, [ordered.KEY, ordered.CHUNK], "left")
    ind = F.when(_finish(spec), F.lit(1)) \
        .when((F.col("_pn") + F.col("_ln")) > 0, F.lit(None)) \
        .otherwise(F.col("_ps") + F.coalesce(F.col("_ls"), F.lit(0)))
    prev = F.when(F.col("_edge"), F.col("_pts")).otherwise(F.col("_prev"))
    start = F.when(F.col("_u").isNull() | (F.col("_u") > F.col("_s")), F.col("_s.t"))
    d = d.withColumns({
        "PlayPeriod": F.when(ind < 1, "PreGame").when(ind > 1, "PostGame").when(ind == 1, "Game"),
        "Time_delta": F.coalesce(duration_seconds(prev, spec.ts), F.lit(0.0)),
        "GameStarted": start,
        "GameFinished": F.col("_f.t"),
    }).withColumns({
        "GameTimeSpent": duration_seconds("GameStarted", spec.ts),
        "GameTimeLeft": duration_seconds(spec.ts, "GameFinished"),
    })
    return drop_scan_keys(d).drop("_mk", "_ls", "_ln", "_prev", "_edge", "_ps", "_pn", "_pts",
                                  "_s", "_u", "_f")


def prepare(df: DataFrame, spec: SessionSpec = DEFAULT, rate_unit: str = "second") -> DataFrame:
    """The cleaned table: periods, durations, game clock (one fused session
    pass, one shuffle of the rows on (session, chunk)), then the sample rate
    (one shuffle by time bucket)."""
    return rate(session_pass(df, spec), spec, unit=rate_unit)
