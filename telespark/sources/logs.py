"""Delimited game logs: find, read, union by column name, merge with metadata.

A log directory holds three kinds of files, told apart by a pattern on their
path (by default the name ends in ``Event.csv``, ``Sample.csv`` or
``Meta.csv``).  All values are read as text; ``NULL`` and empty fields are
missing.  Files of one kind may have different headers: columns are matched
by *name*, missing ones are null.

One scan takes every line with its path and place, and writes them to
Parquet in the shared folder: the files are read once, and many small files
become few large ones.  Small files are read whole and cut into lines, large
and packed ones by Spark's text reader, which pays some milliseconds for each
file it opens.  In a local or mounted folder tasks list the files and read the
small ones (``files.py``), and the driver holds no list of them; on other file
systems Spark's readers do.  Files whose names do not match are dropped when
the folders are listed and never opened.  Lines become records (``quoted.py``): a
quoted field may hold line breaks, also across the borders of file splits.
The first record of each file (smallest row id of the split at byte 0) is its
header; only the *distinct* headers reach the driver.  Each record is parsed
with its own file's header, so files of any mix of headers are one scan.

``RowId`` records load order - kind (event before sample before meta), path,
position in the file - as a sortable struct and is the tie-breaker for equal
timestamps.
"""

from __future__ import annotations

import csv
import io
import logging
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telespark.session import scratch_path, written
from telespark.sources import files, quoted

log = logging.getLogger(__name__)

# Metadata columns renamed before the merge (they clash with
# log columns of the same name) and the path piece names.
META_RENAMES = {"Timestamp": "MetaTimestamp", "Email": "MetaEmail", "Framecount": "MetaFramecount"}
SLASH_PIECES = ("i0", "i1", "i2", "i3", "i4")
UNDERSCORE_PIECES = ("i5", "i6", "i7", "i8", "i9")

KIND_RANK = {"event": 0, "sample": 1, "meta": 2}

#: Files of at most so many bytes are read whole; the text reader splits larger ones over tasks and unpacks packed ones.
WHOLE_FILE = 4 << 20
#: Larger and packed files that one read of the text reader takes.
LARGE_FILES = 10_000
PACKED = r"\.(gz|gzip|bz2|deflate|lz4|snappy|zst|zstd)$"
_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: Listings and whole files are dealt over so many tasks a core: one for each folder, or for every 32 files, costs more than its work.
TASKS_A_CORE = 8


# ------------------------------------------------------------------ scanning

def _path() -> Column:
    """Path of the file a row comes from, as its folders are really named
    (the metadata column escapes spaces and other characters)."""
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:///", "file:/")


def _base(spark: SparkSession, root: str) -> str:
    """The root as it stands at the start of every path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:///", "file:/", 1).rstrip("/")


def _names(line: str, sep: str) -> list[str]:
    return [n.strip() for n in next(csv.reader(io.StringIO(line.lstrip("\ufeff"), newline=""), delimiter=sep), [])]


def _below(spark: SparkSession, fmt: str, root: str | list[str]) -> DataFrame:
    """The files below the root, or of a list, by one of Spark's readers; its folders are listed here."""
    before = spark.conf.get(_LISTING_TASKS)
    spark.conf.set(_LISTING_TASKS, str(min(int(before), TASKS_A_CORE * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.format(fmt).option("recursiveFileLookup", "true").load(root)
    finally:
        spark.conf.set(_LISTING_TASKS, before)


def _cut(whole: DataFrame) -> DataFrame:
    """(value, path, split, row) of files (path, split, content) that were read whole."""
    text = F.regexp_replace(F.col("content").cast("string"), r"\A\x{FEFF}|(\r\n|\n|\r)\z", "")
    lines = whole.where(F.col("content") != F.unhex(F.lit("EFBBBF"))).select("path", "split", F.explode(F.split(text, r"\r\n|\n|\r")).alias("value"))
    return lines.select("value", "path", "split", F.monotonically_increasing_id().alias("row"))


def _by_text_reader(spark: SparkSession, paths: str | list[str], wanted: Column) -> DataFrame:
    """(value, path, split, row) of the wanted files by Spark's text reader."""
    large = _below(spark, "text", paths).withColumn("path", _path()).where(wanted)
    return large.select("value", "path", F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))


def _large(spark: SparkSession, listing: DataFrame) -> DataFrame | None:
    """Lines of the listed files by the text reader; None if there are none.

    The reader keeps a status of each file on the driver, so more than
    ``LARGE_FILES`` are read in portions, written one after the other."""
    paths = (files.escaped(r["path"]) for r in listing.select("path").toLocalIterator())
    portion, rest = list(islice(paths, LARGE_FILES)), list(islice(paths, LARGE_FILES))
    if not rest:
        return _by_text_reader(spark, portion, F.lit(True)) if portion else None
    out = scratch_path(spark, f"large-{uuid.uuid4().hex}")
    while portion:
        d = _by_text_reader(spark, portion, F.lit(True))
        d.write.mode("append").option("compression", "zstd").parquet(out)
        portion, rest = rest, list(islice(paths, LARGE_FILES))
    return spark.read.schema(d.schema).parquet(out)


def _lines(spark: SparkSession, root: str, wanted: Column) -> DataFrame:
    """(value, path, split, row): the lines of the files whose path is wanted; ``row`` grows along a split.

    Lines end as the text reader ends them, at ``\\n``, ``\\r`` or both."""
    tasks = max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    listing = files.listed(spark, root)
    if listing is not None:
        listing = written(listing.where((F.col("size") > 0) & wanted), "files")
        whole = (F.col("size") <= WHOLE_FILE) & ~F.lower("path").rlike(PACKED)
        # Dealt out by path: the listing is a few small files, what it names is not.
        read = files.contents(listing.where(whole).repartition(tasks, "path"))
        lines, large = _cut(read.withColumn("split", F.lit(0).cast("long"))), _large(spark, listing.where(~whole))
        return lines if large is None else lines.unionByName(large)
    size = F.col("_metadata.file_size")
    whole = (size <= WHOLE_FILE) & ~F.lower(F.col("_metadata.file_path")).rlike(PACKED)
    # The filters use the path and the size alone, so they are applied to the list of files.
    found = _below(spark, "binaryFile", root).withColumn("path", _path()).where(wanted)
    lines = _cut(found.where(whole & (size > 0)).coalesce(tasks).select("path", F.col("_metadata.file_block_start").alias("split"), "content"))
    if found.where(~whole).select("path").isEmpty():
        return lines
    return lines.unionByName(_by_text_reader(spark, root, wanted & ~whole))


@dataclass
class LogScan:
    """Every record of the matching files below a root.

    ``records``: kind, path, split, row, value, header (the file's first
    record); ``files``: kind, path, filename - one row for each non-empty
    file; ``headers``: the distinct first records of each kind.
    """

    records: DataFrame
    files: DataFrame
    headers: dict[str, list[str]]
    sep: str

    def table(self, kind: str) -> DataFrame | None:
        """All files of one kind as one text table with ``filename`` and
        ``RowId``, columns matched by name; None if no file has a header."""
        headers = self.headers.get(kind)
        if not headers:
            return None
        d, parsed = self.records.filter((F.col("kind") == kind) & ~F.col("first")), {}
        for i, line in enumerate(headers):
            names = _names(line, self.sep)
            fields, seen = [], set()
            for k, n in enumerate(names):  # unnamed and repeated columns only keep their place
                used = n if n and n not in seen else f"_skip{k}"
                seen.add(n)
                fields.append("`{}` string".format(used.replace("`", "``")))
                if used == n:
                    parsed.setdefault(n, []).append(f"_h{i}")
            row = F.from_csv("value", ", ".join(fields), {"sep": self.sep, "nullValue": "NULL", "escape": '"', "mode": "PERMISSIVE"})
            d = d.withColumn(f"_h{i}", F.when(F.col("header") == line, row))
        cols = [F.nullif(F.coalesce(*(F.col(h).getField(n) for h in hs)), F.lit("")).alias(n) for n, hs in parsed.items()]
        row_id = F.struct(F.lit(KIND_RANK[kind]).alias("kind"), F.col("path").alias("file"),
                          F.col("split"), F.col("row"))
        return d.select("filename", *cols, row_id.alias("RowId"))


def scan(spark: SparkSession, root: str, patterns: Mapping[str, str], sep: str = ";",
         label: str | None = None) -> LogScan:
    """Read the files below ``root`` whose relative path matches a kind's
    pattern (a regular expression, searched as R's ``list.files`` does).

    ``label`` is how the root is spelled in ``filename`` (R's
    ``full.names=TRUE``).  ``root`` may be one file."""
    base, label = _base(spark, root), root if label is None else label
    below = F.col("path").startswith(base + "/")
    rel = F.when(below, F.expr(f"substring(path, {len(base) + 2})")).otherwise(F.col("path"))
    kind = F.lit(None).cast("string")
    for k, pattern in reversed(patterns.items()):
        kind = F.when(rel.rlike(pattern), k).otherwise(kind)
    filename = F.when(below, F.concat(F.lit(label + "/"), rel)).otherwise(F.lit(label))
    d = _lines(spark, root, kind.isNotNull()).withColumns({"filename": filename, "kind": kind})
    records = quoted.records(written(quoted.with_states(d, sep), "lines"))
    heads = (records.filter(F.col("split") == 0).groupBy("kind", "path", "filename")
             .agg(F.min_by("value", "row").alias("header"), F.min("row").alias("_first")))
    distinct = heads.filter(F.trim("header") != "").select("kind", "header").distinct().collect()
    headers: dict[str, list[str]] = {}
    for r in sorted(distinct):
        headers.setdefault(r["kind"], []).append(r["header"])
    records = records.join(heads.select("path", "header", "_first"), "path").filter(F.trim("value") != "")
    first = (F.col("split") == 0) & (F.col("row") == F.col("_first"))
    return LogScan(records.withColumn("first", first).drop("_first"), heads.select("kind", "path", "filename"), headers, sep)


def path_split(df: DataFrame, col: str = "filename", keep: bool = True) -> DataFrame:
    """Split the path on "_" into i5..i9 and on "/" into i0..i4, as the pieces
    stand; extra pieces are dropped, missing ones are null."""
    us = F.split(F.col(col), "_")
    sl = F.split(F.col(col), "/")
    pieces = {n: F.get(us, i) for i, n in enumerate(UNDERSCORE_PIECES)}
    pieces.update({n: F.get(sl, i) for i, n in enumerate(SLASH_PIECES)})
    d = df.withColumns(pieces)
    return d if keep else d.drop(col)


def meta_rename(meta: DataFrame) -> DataFrame:
    """Prefix the metadata columns that clash with log columns.  All three
    must exist; otherwise the table is returned unchanged and a message is
    logged (the reference prints the table and the error)."""
    missing = [c for c in META_RENAMES if c not in meta.columns]
    if missing:
        log.warning("metadata lacks %s; columns left unchanged", ", ".join(missing))
        return meta
    return meta.withColumnsRenamed(META_RENAMES)


def paths_as_meta(scanned: LogScan) -> DataFrame:
    """Without metadata files: the list of read files is the metadata (path
    pieces, no session id)."""
    files = scanned.files.filter(F.col("kind") != "meta").select("filename")
    return path_split(files).withColumn("SessionID", F.lit(None).cast("string"))


# ------------------------------------------------------------------ merging

def union_logs(event: DataFrame | None, sample: DataFrame | None) -> DataFrame | None:
    """Events then samples, columns matched by name (``bind_rows``)."""
    if event is None:
        return sample
    if sample is None:
        return event
    return event.unionByName(sample, allowMissingColumns=True)


def has_session_ids(meta: DataFrame) -> bool:
    """``length(na.omit(unique(SessionID))) >= 1`` - one cheap action."""
    return "SessionID" in meta.columns and not meta.filter(F.col("SessionID").isNotNull()).isEmpty()


def merge_logs(meta: DataFrame, event: DataFrame | None, sample: DataFrame | None,
               on: str | None = None) -> DataFrame:
    """Logs left-joined with metadata on ``SessionID`` or, when the metadata
    has no session id at all, on ``filename``.  Missing keys match each other
    (as dplyr's joins do); duplicate metadata rows fan out; other columns
    present on both sides get ``.x``/``.y`` suffixes.  The join strategy is
    left to AQE (the metadata side is broadcast only when measured small)."""
    data = union_logs(event, sample)
    if data is None:
        raise ValueError("no event or sample rows to merge")
    key = on or ("SessionID" if has_session_ids(meta) else "filename")
    if key == "filename" and "SessionID" in meta.columns:
        meta = meta.drop("SessionID")
    if key == "SessionID" and "filename" in meta.columns and "filename" in data.columns:
        meta = meta.drop("filename")
    if key not in data.columns:
        data = data.withColumn(key, F.lit(None).cast("string"))
    both = [c for c in meta.columns if c in data.columns and c != key]
    data = data.withColumnsRenamed({c: f"{c}.x" for c in both})
    meta = meta.withColumnsRenamed({c: f"{c}.y" for c in both}).withColumnRenamed(key, "_mkey")
    j = data.join(meta, data[key].eqNullSafe(meta["_mkey"]), "left").drop("_mkey")
    return j


# ------------------------------------------------------------------ entry points

def load_logs(spark: SparkSession, root: str, event: str | None = "Event",
              sample: str | None = "Sample", meta: str | None = "Meta", sep: str = ";",
              label: str | None = None) -> DataFrame:
    """Load a log directory (``LoadFromDirectory``).

    ``event``/``sample``/``meta`` are the name patterns of each kind (a
    kind set to ``None`` is skipped); files match ``<pattern>\\.csv$``.
    ``label`` is how the root is spelled in ``filename`` (default: ``root``
    as given), which fixes the positions of the path pieces i0..i4.
    """
    patterns = {k: p + r"\.csv$" for k, p in (("event", event), ("sample", sample), ("meta", meta)) if p}
    scanned = scan(spark, root, patterns, sep, label)
    info = scanned.table("meta") if meta is not None else None
    info = paths_as_meta(scanned) if info is None else meta_rename(path_split(info, keep=False).drop("RowId"))
    return merge_logs(info, scanned.table("event"), scanned.table("sample"))


def load_triplet(spark: SparkSession, meta_path: str, event_path: str, sample_path: str,
                 sep: str = ";", pattern: str = r"\.csv$") -> DataFrame:
    """Read one metadata/event/sample triple given as paths (files or
    directories) and merge them on the session id (``LoadFromFilePaths``, as
    intended)."""
    m, e, s = (scan(spark, p, {k: pattern}, sep).table(k)
               for k, p in (("meta", meta_path), ("event", event_path), ("sample", sample_path)))
    m = meta_rename(m.drop("RowId", "filename")) if m is not None else spark.createDataFrame([], "SessionID string")
    return merge_logs(m, e, s, on="SessionID")
