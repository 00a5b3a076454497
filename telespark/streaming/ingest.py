"""Incremental ingest of log files as they arrive (Structured Streaming).

The batch loader (:mod:`telespark.sources.logs`) reads a finished log
directory.  When sessions keep writing files, the same data can be picked up
incrementally: a file stream per log kind appends new rows to the raw Parquet
table (exactly once, progress kept in a checkpoint in the shared folder), and
the batch plans run on that table.  A streaming file source needs one schema,
so each kind is read with a declared header (one logger version); folders
mixing header versions go through the batch loader.

The per-second sample rate (``Hz``) is also available as a streaming,
watermarked window aggregate, for monitoring a running session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from telespark.functions.time import parse_timestamp
from telespark.operators.sessions import SAMPLE


def log_stream(spark: SparkSession, log_dir: str, kind: str, columns: Sequence[str],
               sep: str = ";", max_files: int | None = None) -> DataFrame:
    """Streaming text table of the files named ``*<kind>.csv`` below
    ``log_dir`` (all values text, ``NULL`` and empty fields missing), with
    the source path in ``filename``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    r = (spark.readStream.schema(schema)
         .options(sep=sep, header=True, nullValue="NULL", recursiveFileLookup=True,
                  pathGlobFilter=f"*{kind}.csv"))
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    d = r.csv(log_dir)
    return d.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in columns],
                    F.col("_metadata.file_path").alias("filename"),
                    F.lit(kind).alias("kind"))


def ingest(spark: SparkSession, log_dir: str, out_path: str, checkpoint: str, kind: str,
           columns: Sequence[str], sep: str = ";", available_now: bool = True) -> StreamingQuery:
    """Append newly arrived ``kind`` files to the raw Parquet table at
    ``out_path``.  ``available_now`` processes what is there and stops
    (scheduled runs); otherwise the query keeps running."""
    w = (log_stream(spark, log_dir, kind, columns, sep).writeStream
         .format("parquet").option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(out_path)


def sample_rate_stream(logs: DataFrame, ts: str = "Timestamp", event: str = "Event",
                       lateness: str | None = None) -> DataFrame:
    """Streaming ``Hz``: Sample rows per wall-clock second over all sessions,
    null when the second holds a row with a missing event.  Every row counts,
    however late (update or complete mode).  With ``lateness`` a watermark
    bounds the state and allows append mode; rows later than that are lost."""
    # watermarks need TIMESTAMP; the window start is cast back to wall time
    d = logs.withColumn("_ts", parse_timestamp(ts).cast("timestamp"))
    if lateness is not None:
        d = d.withWatermark("_ts", lateness)
    ev = F.col(event)
    g = d.groupBy(F.window("_ts", "1 second").alias("w")).agg(
        F.sum(F.when(ev == SAMPLE, 1).otherwise(0)).alias("_n"),
        F.max(ev.isNull().cast("int")).alias("_u"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("second"),
                    F.when(F.col("_u") == 1, F.lit(None)).otherwise(F.col("_n")).cast("long").alias("Hz"))
