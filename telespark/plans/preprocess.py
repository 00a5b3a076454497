"""Plan E1: raw log directory -> cleaned, prepared table on Parquet.

Load (find, read, union, merge) -> save raw -> typed projection -> play
periods, durations, game clock, sample rate -> save in ranges of (session, time).
Writing the raw table cuts the lineage of the file scans, so a lost executor
only recomputes from Parquet.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from telespark.operators.clean import clean
from telespark.operators.sessions import DEFAULT, SessionSpec, prepare
from telespark.sources import logs, sinks


def preprocess(spark: SparkSession, log_dir: str, out_dir: str, *,
               event: str | None = "Event", sample: str | None = "Sample",
               meta: str | None = "Meta", sep: str = ";", label: str | None = None,
               participant: str = "i2", condition: str = "i3",
               spec: SessionSpec = DEFAULT, rate_unit: str = "second") -> DataFrame:
    raw_path = os.path.join(out_dir, "raw")
    clean_path = os.path.join(out_dir, "clean")
    raw = logs.load_logs(spark, log_dir, event=event, sample=sample, meta=meta, sep=sep,
                         label=label)
    sinks.write_raw(raw, raw_path)
    typed = clean(spark.read.parquet(raw_path), participant=participant, condition=condition)
    prep = prepare(typed, spec, rate_unit=rate_unit)
    schema = sinks.write_clean(prep, clean_path, spec.keys)
    return sinks.read_clean(spark, clean_path, schema)
