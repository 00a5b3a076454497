"""Write a table of logs as a delimited log tree (the loader's input format).

Rows go to ``<root>/Participant=<p>/Condition=<c>/kind=<Event|Sample|Meta>/``
as ``;``-separated text with a header, ``NULL`` for missing values and
timestamps with microseconds; half of the sessions have their columns in
another order.  Used to derive log files from the driver
tables so the loader is exercised on data that grows with them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telespark.operators.ordered import order_key
from telespark.operators.sessions import SAMPLE
from telespark.sources.files import local_folder

SEP = ";"
TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
OPTIONS = {"sep": SEP, "nullValue": "NULL", "timestampNTZFormat": TS_FORMAT}
KIND_PATTERNS = {"event": "kind=Event/[^/]*", "sample": "kind=Sample/[^/]*", "meta": "kind=Meta/[^/]*"}


def session_meta(logs: DataFrame, keys=("Participant", "Condition")) -> DataFrame:
    """One metadata row per session: id, first timestamp, contact, first frame."""
    first = F.min_by(F.struct("Timestamp", "Framecount"), order_key("Timestamp", "RowId"))
    return (logs.groupBy(*keys, "SessionID").agg(first.alias("_f"))
            .select(*keys, "SessionID", F.col("_f.Timestamp").alias("Timestamp"),
                    F.concat(F.lower("SessionID"), F.lit("@example.org")).alias("Email"),
                    F.col("_f.Framecount").alias("Framecount")))


def _lines(table: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """(parts as text, version, header, line): every row as it stands in its file."""
    # Two logger versions: sessions of the second write their columns in reverse.
    second = F.pmod(F.xxhash64(*keys), F.lit(2)) == 1
    names = [c for c in table.columns if c not in parts]

    def either(make) -> Column:
        return F.when(second, make(names[::-1])).otherwise(make(names))

    return table.select(*(F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in parts), second.cast("int").alias("version"),
                        either(lambda n: F.lit(SEP.join(n))).alias("header"),
                        either(lambda n: F.to_csv(F.struct(*n), OPTIONS)).alias("line"))


def _folder(names: Sequence[str], values: Sequence[str | None]) -> str:
    """The partition folder of the values, spelled as Spark's own writer does."""
    text = (re.sub(r'[\x01-\x1f"#%\'*/:=?\\\x7f{\[\]^]', lambda m: f"%{ord(m[0]):02X}", v) if v else "__HIVE_DEFAULT_PARTITION__" for v in values)
    return "/".join(f"{n}={v}" for n, v in zip(names, text))


def _write_files(root: str, parts: Sequence[str]):
    """Task that writes its sorted lines, one file after the other; a file gets its name when it is whole."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at, out, place = 0, None, None, ("", "")
        attempt = TaskContext.get().taskAttemptId()

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(*place)

        for batch in batches:
            for *key, version, header, line in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or [*key, version] != at:
                    close()
                    at, files = [*key, version], files + 1
                    folder = os.path.join(root, _folder(parts, key))
                    os.makedirs(folder, exist_ok=True)
                    place = (os.path.join(folder, f".log{version}-{attempt}"), os.path.join(folder, f"log{version}.csv"))
                    out = open(place[0], "wb")
                    out.write(header.encode() + b"\n")
                out.write(line.encode() + b"\n")
        close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})
    return task


def write_log_tree(logs: DataFrame, root: str, keys=("Participant", "Condition")) -> str:
    """Write events, samples and session metadata below ``root``, one file per session and kind, as a logger writes them.

    In a local or mounted folder the tasks write their files themselves:
    without its native library Hadoop's local file system starts a ``chmod``
    process for every file and every checksum file."""
    kind = F.when(F.col("Event") == SAMPLE, "Sample").otherwise("Event")
    body = logs.drop("RowId").withColumn("kind", kind)
    meta = session_meta(logs, keys).withColumn("kind", F.lit("Meta"))
    parts = [*keys, "kind"]
    folder = local_folder(logs.sparkSession, root)
    if folder is not None:
        lines = _lines(body, keys, parts).unionByName(_lines(meta, keys, parts))
        file = [*parts, "version"]
        lines.repartition(*file).sortWithinPartitions(*file).mapInArrow(_write_files(folder, parts), "files long").agg(F.sum("files")).collect()
        return root
    second = F.pmod(F.xxhash64(*keys), F.lit(2)) == 1
    for part in (body, meta):
        turned = part.select(*reversed([c for c in part.columns if c not in parts]), *parts)
        for version in (part.filter(~second), turned.filter(second)):
            version.repartition(*parts).write.mode("append").partitionBy(*parts).options(header=True, **OPTIONS).csv(root)
    return root
