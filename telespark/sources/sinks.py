"""Parquet sinks for the raw and the cleaned log tables.

The cleaned table is laid out by ranges of (session, time): its files follow
its size, not the number of sessions, and hold a run of the order each.  A
small index beside it has the first and last session and time of every file,
so a query for a session, or for a span of time in it, opens only the files
that can hold its rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one file at most; small ranges are joined to about the session's advisory partition size.
FILE_ROWS = 4_000_000


def write_raw(raw: DataFrame, path: str) -> None:
    """Merged text logs as loaded (the raw checkpoint of the pipeline)."""
    raw.write.mode("overwrite").parquet(path)


def _place(path: str) -> tuple[str, str]:
    return f"{path.rstrip('/')}/rows", f"{path.rstrip('/')}/index"


def write_clean(prep: DataFrame, path: str, keys: Sequence[str] = ("Participant", "Condition"), ts: str = "Timestamp",
                file_rows: int = FILE_ROWS) -> T.StructType:
    """Write the cleaned table in ranges of (keys, time), and the index of its files.

    A session of any size is as many files as it fills; many small sessions
    share one.  Returns the schema to read it back with."""
    rows, index = _place(path)
    order = [*keys, ts] if ts in prep.columns else list(keys)
    prep.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(rows)
    spark = prep.sparkSession
    at = F.struct(*order)
    files = spark.read.schema(prep.schema).parquet(rows).groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("rows"))
    files.coalesce(1).write.mode("overwrite").parquet(index)
    return prep.schema


def _may_hold(wanted: Mapping[str, object], order: Sequence[T.StructField]) -> Column:
    """Files whose run of the order can hold rows with the wanted values (of the first columns; null is a value)."""
    names = []
    for f in order:
        if f.name not in wanted:
            break
        names.append(f)
    if not names:
        return F.lit(True)
    value = F.struct(*(F.lit(wanted[f.name]).cast(f.dataType).alias(f.name) for f in names))
    low, high = (F.struct(*(F.col(side)[f.name].alias(f.name) for f in names)) for side in ("first", "last"))
    return (low <= value) & (value <= high)


def clean_files(spark: SparkSession, path: str, wanted: Mapping[str, object]) -> list[str]:
    """Files that can hold the wanted rows, from the index."""
    index = spark.read.parquet(_place(path)[1])
    return sorted(r["file"] for r in index.where(_may_hold(wanted, index.schema["first"].dataType.fields)).select("file").collect())


def read_clean(spark: SparkSession, path: str, schema: T.StructType | None = None, wanted: Mapping[str, object] | None = None) -> DataFrame:
    """Read the cleaned table, or of it the rows with the wanted values (``{"Participant": 3.0}``; None: missing).

    With the schema returned by :func:`write_clean` no file is opened to find
    the schema."""
    rows = _place(path)[0]
    if schema is None:
        schema = spark.read.parquet(rows).schema
    if not wanted:
        return spark.read.schema(schema).parquet(rows)
    files = clean_files(spark, path, wanted)
    d = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    for c, v in wanted.items():
        d = d.where(F.col(c).eqNullSafe(F.lit(v).cast(schema[c].dataType)))
    return d
