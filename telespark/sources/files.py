"""Files of a local or mounted folder, listed and read whole in tasks.

Spark's file readers hold a status of every file on the driver, several times
while a query is planned.  Logs are many small files, so that list outgrows
any driver.  Here the folders of one level are dealt out over tasks by a hash
of their path; each task walks its own and hands on (path, size) as rows, so
what the driver sees is the names of the few folders above that level.

What is a file, what is passed over and how ``*``, ``?``, ``[]`` and ``{}``
in the root are read is as in Spark's readers.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Folders of a level before it is dealt out, for each listing task.
FOLDERS_A_TASK = 64
#: Rows of a listed batch, bytes of a batch of files' contents.
ROWS_AT_ONCE = 10_000
BYTES_AT_ONCE = 8 << 20

_GLOB = re.compile(r"[{}\[\]*?\\]")


def local_folder(spark: SparkSession, root: str) -> str | None:
    """The root as a folder of the operating system; None on any other file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def escaped(path: str) -> str:
    """The path as Spark's readers take it, with no character of a pattern."""
    return _GLOB.sub(r"\\\g<0>", path)


def _hidden(name: str) -> bool:
    """Files and folders that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _steps(spark: SparkSession, folder: str) -> tuple[str, list[str]] | None:
    """(folder before the first pattern, regular expressions of the names from there on); None if braces hold a slash."""
    names = folder.split("/")
    at = next((i for i, n in enumerate(names) if _GLOB.search(n)), len(names))
    if any(n.count("{") != n.count("}") for n in names):
        return None
    glob = spark._jvm.org.apache.hadoop.fs.GlobPattern
    return "/".join(names[:at]) or "/", [glob(n).compiled().pattern() if _GLOB.search(n) else re.escape(n) for n in names[at:]]


def _entries(folder: str, level: int, steps: list[re.Pattern]) -> Iterator[tuple[str, bool, int]]:
    """(path, is a folder, size) of what the walk goes on with in a folder ``level`` levels below its start."""
    try:
        with os.scandir(folder) as found:
            for e in found:
                inside = e.is_dir()
                if level < len(steps) and not steps[level].fullmatch(e.name):
                    continue
                if not inside and level + 1 < len(steps):
                    continue
                if _hidden(e.name) and not (inside and level < len(steps)):
                    continue
                try:
                    yield e.path, inside, 0 if inside else e.stat().st_size
                except FileNotFoundError:  # a link to nothing, or gone since
                    continue
    except (FileNotFoundError, NotADirectoryError):
        return


def _walk(folder: str, level: int, steps: list[re.Pattern], dealt: int, mine) -> Iterator[tuple[str, int]]:
    """Files below a folder.  Whatever stands on the dealt level, and files above it, belong to one task."""
    for path, inside, size in _entries(folder, level, steps):
        if inside:
            if level + 1 != dealt or mine(path):
                yield from _walk(path, level + 1, steps, dealt, mine)
        elif level + 1 > dealt or mine(path):
            yield path, size


def _matches(folder: str, level: int, steps: list[re.Pattern]) -> bool:
    """Does anything match the patterns?"""
    return level == len(steps) or any(level + 1 == len(steps) or inside and _matches(path, level + 1, steps)
                                      for path, inside, _ in _entries(folder, level, steps))


def _dealt_level(start: str, steps: list[re.Pattern], enough: int) -> int:
    """First level with enough folders to deal out, or the last one with folders."""
    level, folders = 0, [start]
    while folders:
        below = []
        for path in (path for f in folders for path, inside, _ in _entries(f, level, steps) if inside):
            below.append(path)
            if len(below) >= enough:
                return level + 1
        level, folders = level + 1, below
    return max(level - 1, 1)


def _list(start: str, patterns: list[str], dealt: int, tasks: int):
    """Task that lists its share of the files."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = [re.compile(p, re.DOTALL) for p in patterns]
        for me in (i for batch in batches for i in batch.column(0).to_pylist()):
            def mine(path: str) -> bool:
                return zlib.crc32(os.fsencode(path)) % tasks == me

            if os.path.isdir(start):
                found = _walk(start, 0, steps, dealt, mine)
            else:
                found = iter([(start, os.path.getsize(start))] if mine(start) and not _hidden(os.path.basename(start)) else [])
            while some := list(islice(found, ROWS_AT_ONCE)):
                yield pa.RecordBatch.from_arrays([pa.array([f"file:{p}" for p, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["path", "size"])
    return task


def listed(spark: SparkSession, root: str) -> DataFrame | None:
    """(path, size) of the files below the root, listed by tasks; None where only Spark's readers can list them."""
    folder = local_folder(spark, root)
    found = folder and _steps(spark, folder)
    if not found:
        return None
    start, patterns = found
    steps = [re.compile(p, re.DOTALL) for p in patterns]
    if not os.path.exists(start) or not _matches(start, 0, steps):
        spark.read.text(root)  # says what is missing
    tasks = spark.sparkContext.defaultParallelism
    dealt = _dealt_level(start, steps, FOLDERS_A_TASK * tasks) if os.path.isdir(start) else 1
    return spark.range(0, tasks, 1, tasks).mapInArrow(_list(start, patterns, dealt, tasks), "path string, size long")


def contents(listing: DataFrame) -> DataFrame:
    """(path, content) of the listed files, each read whole by the task that holds its row."""
    return listing.select("path").mapInArrow(_read, "path string, content binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths, held = [], []

    def batch() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.binary())], ["path", "content"])
        paths.clear(), held.clear()
        return done

    size = 0
    for path in (p for b in batches for p in b.column(0).to_pylist()):
        with open(path.removeprefix("file:"), "rb") as f:
            held.append(f.read())
        paths.append(path)
        size += len(held[-1])
        if size >= BYTES_AT_ONCE or len(paths) >= ROWS_AT_ONCE:
            yield batch()
            size = 0
    if paths:
        yield batch()
