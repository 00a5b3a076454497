"""Typed projection of the merged text log table.

Raw logs are read as text.  One projection renames the path-derived session
keys, parses the timestamp, casts the known numeric columns and puts
``Timestamp, Event`` first; known columns missing from the input are added as
typed nulls so downstream operators see a stable schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telespark.functions.nulls import nan_to_null
from telespark.functions.time import cast_numeric, parse_timestamp

# Columns the analysis reads, with their types after cleaning.
NUMERIC_COLUMNS = (
    "Framecount", "GameTimeSpent",
    "MolePositionWorldX", "MolePositionWorldY", "MolePositionWorldZ",
    "RightControllerLaserPosWorldX", "RightControllerLaserPosWorldY",
    "RightControllerLaserPosWorldZ",
    "WorldGazeHitPositionX", "WorldGazeHitPositionY", "WorldGazeHitPositionZ",
    "GazeConfidence",
)
TEXT_COLUMNS = ("Event", "SessionID", "MoleId", "MoleSpawnOrder", "PatternSegmentLabel",
                "MoleSize", "Condition")

KNOWN_TYPES: dict[str, T.DataType] = {
    "Timestamp": T.TimestampNTZType(),
    "Participant": T.DoubleType(),
    **{c: T.DoubleType() for c in NUMERIC_COLUMNS},
    **{c: T.StringType() for c in TEXT_COLUMNS},
}


def conform(df: DataFrame) -> DataFrame:
    """Add every known column that is missing, as a typed null."""
    missing = {c: F.lit(None).cast(t) for c, t in KNOWN_TYPES.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def reorder(df: DataFrame, first: Sequence[str] = ("Timestamp", "Event")) -> DataFrame:
    """The named columns first, the others after them in their order."""
    return df.select(*first, *[c for c in df.columns if c not in first])


def sort_time(df: DataFrame, ts: str = "Timestamp", tie: str = "RowId") -> DataFrame:
    """Rows in time order, missing times last, load order on ties: ranges of
    time in separate partitions, each sorted (files written from it prune by time)."""
    order = [F.col(ts).asc_nulls_last(), F.col(tie)]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def clean(raw: DataFrame, participant: str = "i2", condition: str = "i3") -> DataFrame:
    """Typed table from the merged text logs.

    ``participant``/``condition`` name the path pieces holding the session
    keys (they depend on the depth of the log root).  ``RowId`` (load order)
    is kept as the tie-breaker for equal timestamps.
    """
    d = raw
    ren = {k: v for k, v in ((participant, "Participant"), (condition, "Condition"))
           if k in d.columns}
    if ren:
        d = d.withColumnsRenamed(ren)
    casts = {"Timestamp": parse_timestamp("Timestamp")} if "Timestamp" in d.columns else {}
    if "Participant" in d.columns:
        casts["Participant"] = nan_to_null(cast_numeric("Participant"))
    casts.update({c: nan_to_null(cast_numeric(c)) for c in NUMERIC_COLUMNS if c in d.columns})
    return reorder(conform(d.withColumns(casts)))
