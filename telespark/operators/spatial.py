"""Spatial travel between consecutive spawned targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark.functions.nulls import count_if, in_set, nan_to_null, strict_sum
from telespark.functions.scalars import concat_label, euclid_distance, make_point
from telespark.functions.time import cast_integer
from telespark.operators import existence, ordered
from telespark.operators.sessions import DEFAULT, MOLE_SPAWNED, SessionSpec
from telespark.session import written

# The target ids marked for measurement in the travel plot.
MEASURE_MOLES = ('0705', '0104', '0505', '0701', '0902', '0501', '0205', '0401',
                 '0303', '0201', '0605', '0803')

X, Y = "MolePositionWorldX", "MolePositionWorldY"


def spawns(prep: DataFrame, spec: SessionSpec = DEFAULT) -> DataFrame:
    """Spawn events of the Game period with their position (``Sm``)."""
    return (prep.filter((F.col(spec.event) == MOLE_SPAWNED) & (F.col("PlayPeriod") == "Game"))
            .select(*spec.keys, spec.ts, spec.tie, "MoleId", X, Y, "MoleSpawnOrder",
                    "PatternSegmentLabel"))


def travel_distance(sp: DataFrame, spec: SessionSpec = DEFAULT) -> DataFrame:
    """``distance_lag``: planar distance to the previous spawn of the same
    session; null for the first spawn and for missing coordinates."""
    d = ordered.shift(sp, spec.keys, spec.ts, spec.tie, {X: "_px", Y: "_py"}, unit=spec.unit)
    d = ordered.drop_scan_keys(d)
    return d.withColumns({
        "geometry": make_point(X, Y),
        "geometry_lag": make_point("_px", "_py"),
        "distance_lag": euclid_distance(X, Y, "_px", "_py"),
    }).drop("_px", "_py")


def travel_direction(sp: DataFrame, spec: SessionSpec = DEFAULT,
                     scope: str = "global", rows: int | None = None) -> DataFrame:
    """``travelLeadHor``/``travelLeadVer`` against the *next* spawn.

    With ``scope="global"`` the next spawn is taken over all sessions in time
    order, as the reference does after ``ungroup()``; ``scope="session"``
    keeps it within the session.  Right if x > next x, Left if smaller, None
    if equal; Down if y < next y, Up if larger, None if equal; null when a
    value or the next row is missing.  The order is cut into chunks of about
    ``rows`` spawns by the data itself, however crowded a second is; only the
    chunk table, a row for each chunk, is ordered as a whole.
    """
    keys: Sequence[str] = spec.keys if scope == "session" else ()
    d = ordered.range_chunks(sp, keys, [F.col(spec.ts).asc_nulls_last(), F.col(spec.tie)], rows)
    d = ordered.shift(d, keys, spec.ts, spec.tie, {X: "_nx", Y: "_ny"}, lead=True)
    d = ordered.drop_scan_keys(d)
    x, y, nx, ny = (nan_to_null(c) for c in (X, Y, "_nx", "_ny"))
    hor = F.when(x == nx, "None").when(x > nx, "Right").when(x < nx, "Left")
    ver = F.when(y == ny, "None").when(y < ny, "Down").when(y > ny, "Up")
    return d.withColumns({"travelLeadHor": hor, "travelLeadVer": ver}).drop("_nx", "_ny")


def geometry_lead(sp: DataFrame, spec: SessionSpec = DEFAULT) -> DataFrame:
    """Point of the next spawn of the same session; null for the last one."""
    d = ordered.shift(sp, spec.keys, spec.ts, spec.tie, {X: "_nx", Y: "_ny"}, lead=True, unit=spec.unit)
    d = ordered.drop_scan_keys(d)
    return d.withColumn("geometry_lead", make_point("_nx", "_ny")).drop("_nx", "_ny")


def spawn_travel(prep: DataFrame, spec: SessionSpec = DEFAULT, scope: str = "global") -> DataFrame:
    """``Sm``: spawns with distance to the previous and direction to the next.

    The few columns of the spawns are written once; both scans read them."""
    sp = written(spawns(prep, spec), "spawns")
    return travel_direction(travel_distance(sp, spec), spec, scope=scope)


def segment_summary(sm: DataFrame) -> DataFrame:
    """Per pattern segment: summed travel distance and Left/Right counts,
    null when an input is missing (no ``na.rm``)."""
    hor = F.col("travelLeadHor")
    return sm.groupBy("PatternSegmentLabel").agg(
        strict_sum("distance_lag").alias("dist"),
        count_if(hor == "Left").alias("left"),
        count_if(hor == "Right").alias("right"))


def segment_geometry(sm: DataFrame) -> DataFrame:
    """The distinct spawn points of each segment (the union of point geometry),
    one row for each; missing points are left out.  Rows, not a list: a
    segment may hold any number of points."""
    p = sm.filter(F.col("geometry").isNotNull())
    return p.select("PatternSegmentLabel", "geometry.x", "geometry.y").distinct()


def in_set_flag(df: DataFrame, col: str = "MoleId", values: Sequence[str] | DataFrame = MEASURE_MOLES,
                out: str = "measured") -> DataFrame:
    """Flag the rows whose value is one of the measured ids (never null).

    ``values``: a short list, or a table of one column with any number of
    values (``existence.flag``)."""
    if isinstance(values, DataFrame):
        return existence.flag(df, col, values, out)
    return df.withColumn(out, in_set(col, values))


def travel_points(sm: DataFrame) -> DataFrame:
    """Travel distance against spawn order, with the measurement flag."""
    d = in_set_flag(sm)
    return d.select("Participant", "Condition", "RowId", "MoleId",
                    F.col("distance_lag").cast("double").alias("distance"),
                    cast_integer("MoleSpawnOrder").alias("spawn_order"),
                    "PatternSegmentLabel", "measured")


def measured_points(sm: DataFrame) -> DataFrame:
    """The travel points of the measured ids."""
    return travel_points(sm).filter("measured")


def spawn_points(prep: DataFrame, spec: SessionSpec = DEFAULT) -> DataFrame:
    """Game rows with position, segment and hover label (spawn-point check)."""
    return prep.filter(F.col("PlayPeriod") == "Game").select(
        *spec.keys, spec.tie, X, Y, "PatternSegmentLabel",
        concat_label("MoleId", X, Y).alias("label"))
