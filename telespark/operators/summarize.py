"""Per-session summaries of the prepared table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telespark.functions.nulls import in_set, nan_to_null
from telespark.functions.scalars import concat_label
from telespark.functions.time import duration_seconds, trunc_unit
from telespark.operators.sessions import (DEFAULT, FINISH_EVENTS, GAME_STARTED, MOLE_HIT,
                                          MOLE_SPAWNED, SessionSpec)


def _key(spec: SessionSpec):
    # One struct column: null key parts match each other, like dplyr groups.
    return F.struct(*[F.col(c) for c in spec.keys]).alias("_key")


def session_summary(prep: DataFrame, spec: SessionSpec = DEFAULT) -> DataFrame:
    """One row per session *and finish marker* over its Game rows.

    ``PlayTime`` is finish minus start in seconds; a session with k finish
    markers gives k rows, one without a start or finish gives none (R's
    ``summarise`` over a length-k ``difftime``).  Counts and ``MeanHz`` are
    null when an input is missing (no ``na.rm``); gaze means drop missing
    values.

    The rows are read once: they are summed by (session, finish time or none),
    map-side combined, and a window over that small table adds a session's
    sums up beside its finishes.
    """
    ev, ts = F.col(spec.event), F.col(spec.ts)
    game = prep.filter(F.col("PlayPeriod") == "Game").withColumn("_key", _key(spec))
    x, fin = F.col("MolePositionWorldX"), in_set(ev, FINISH_EVENTS)
    counts = {"MoleHitCount": ev == MOLE_HIT, "MolesRight": (ev == MOLE_SPAWNED) & (x > 0), "MolesLeft": (ev == MOLE_SPAWNED) & (x < 0)}
    means = {"MeanGaze_x": "WorldGazeHitPositionX", "MeanGaze_y": "WorldGazeHitPositionY", "MeanGaze_z": "WorldGazeHitPositionZ", "MeanGazeConf": "GazeConfidence"}
    micros, hz = F.round(F.col("Time_delta") * 1e6).cast("long"), F.col("Hz")
    sums = {n: F.sum(c.cast("int")) for n, c in counts.items()}
    sums.update({f"{n}_na": F.count_if(c.isNull()) for n, c in counts.items()})
    for n, c in means.items():
        sums.update({n: F.sum(nan_to_null(c)), f"{n}_n": F.count(nan_to_null(c))})
    sums.update(delta=F.sum(micros), delta_na=F.count_if(F.col("Time_delta").isNull()), hz=F.sum(hz), hz_na=F.count_if(hz.isNull()),
                rows=F.count(F.lit(1)), starts=F.count_if(ev == GAME_STARTED))
    part = game.groupBy("_key", fin.alias("_fin"), F.when(fin, ts).alias("_finish")).agg(
        *(e.alias(f"_{n}") for n, e in sums.items()), F.min(F.when(ev == GAME_STARTED, ts)).alias("_start"))
    own = Window.partitionBy("_key")
    d = part.select("_key", "_fin", "_finish", F.col("_rows").alias("_times"), F.min("_start").over(own).alias("_start"),
                    *(F.sum(f"_{n}").over(own).alias(f"_{n}") for n in sums))
    d = d.filter(F.col("_fin") & (F.col("_starts") >= 1))
    # Finishes at one time are rows of their own.
    d = d.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))

    def strict(value, missing: str):
        return F.when(F.col(missing) == 0, value)

    out = {n: strict(F.col(f"_{n}"), f"_{n}_na") for n in counts}
    out.update({n: F.try_divide(F.col(f"_{n}"), F.col(f"_{n}_n")) for n in means})
    out["PlayTime"] = duration_seconds("_start", "_finish")
    out["PlayTime_delta"] = strict(F.col("_delta").cast("double") / F.lit(1e6), "_delta_na")
    out["MeanHz"] = strict(F.col("_hz") / F.col("_rows"), "_hz_na")
    return d.select(
        *[F.col(f"_key.{c}").alias(c) for c in spec.keys],
        *(out[n].alias(n) for n in ("MoleHitCount", "PlayTime", "PlayTime_delta", *means, "MeanHz", "MolesRight", "MolesLeft")))


def sample_rate_points(prep: DataFrame, spec: SessionSpec = DEFAULT) -> DataFrame:
    """Game rows as (session label, GameTimeSpent, Hz) for the sample-rate plot."""
    return prep.filter(F.col("PlayPeriod") == "Game").select(
        spec.tie, concat_label(*spec.keys).alias("label"), "GameTimeSpent", "Hz")


def session_extent(prep: DataFrame, spec: SessionSpec = DEFAULT, unit: str = "second") -> DataFrame:
    """Per session and finish marker: start and end (truncated to ``unit``)
    and whole elapsed seconds (``as.integer(difftime(...))``), the input of
    the playback grid.  Like the summary, k finish markers give k rows."""
    ev, ts = F.col(spec.event), F.col(spec.ts)
    d = prep.withColumn("_key", _key(spec))
    starts = d.groupBy("_key").agg(
        F.count(F.when(ev == GAME_STARTED, 1)).alias("_starts"),
        F.min(F.when(ev == GAME_STARTED, ts)).alias("_start")).filter(F.col("_starts") >= 1)
    fins = d.filter(in_set(ev, FINISH_EVENTS)).select("_key", ts.alias("_finish"))
    j = fins.join(starts, "_key")
    total = duration_seconds("_start", "_finish")
    return j.select(
        *[F.col(f"_key.{c}").alias(c) for c in spec.keys],
        trunc_unit("_start", unit).alias("time_start"),
        trunc_unit("_finish", unit).alias("time_end"),
        F.when(F.abs(total) < 2147483648.0, total.cast("int")).alias("total_time"))
