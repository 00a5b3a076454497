"""Incremental ingest and the streaming sample rate."""

import os
import tempfile

from telespark.streaming import ingest as S

COLS = ["Timestamp", "Event", "SessionID"]


def _write(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(";".join(COLS) + "\n" + "".join(";".join(r) + "\n" for r in rows))


def test_ingest_appends_new_files_once(spark):
    root = tempfile.mkdtemp(prefix="telespark-stream-")
    logs, out, ck = f"{root}/logs", f"{root}/raw", f"{root}/ck"
    _write(f"{logs}/1/A/a_Sample.csv", [("2024-01-01 10:00:00.1", "Sample", "S1"),
                                        ("2024-01-01 10:00:00.5", "Sample", "S1")])
    S.ingest(spark, logs, out, ck, "Sample", COLS).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    _write(f"{logs}/1/A/b_Sample.csv", [("2024-01-01 10:00:01.2", "NULL", "S1")])
    _write(f"{logs}/1/A/b_Event.csv", [("2024-01-01 10:00:01.3", "Mole Hit", "S1")])
    S.ingest(spark, logs, out, ck, "Sample", COLS).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 3                       # only the new Sample file was added
    assert got.filter("Event IS NULL").count() == 1


def test_sample_rate_stream(spark):
    root = tempfile.mkdtemp(prefix="telespark-stream-")
    logs = f"{root}/logs"
    _write(f"{logs}/1/A/a_Sample.csv", [("2024-01-01 10:00:00.1", "Sample", "S1"),
                                        ("2024-01-01 10:00:00.5", "Sample", "S1"),
                                        ("2024-01-01 10:00:01.2", "NULL", "S1"),
                                        ("2024-01-01 10:00:30.0", "Sample", "S1")])
    rates = S.sample_rate_stream(S.log_stream(spark, logs, "Sample", COLS))
    q = (rates.writeStream.format("memory").queryName("hz_test").outputMode("complete")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {str(r.second): r.Hz for r in spark.sql("SELECT * FROM hz_test").collect()}
    assert got["2024-01-01 10:00:00"] == 2
    assert got["2024-01-01 10:00:01"] is None
