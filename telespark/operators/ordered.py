"""Ordered scans over large, possibly skewed, groups.

R evaluates ``lag``, ``lead``, ``cumsum`` and ``fill`` over a whole group in
one process.  A window partitioned only by the group key does the same in one
Spark task, which breaks when one session holds a large share of all rows.

Here every group is cut into time chunks (``unit_chunk`` of the timestamp; a
chunk holds the rows of one group inside one hour, minute, ...).  The window
runs inside ``(group, chunk)``; a small chunk-level table, one row per
``(group, chunk)``, carries what crosses chunk boundaries (the last row of the
previous chunk, the running total before the chunk, the last non-null value)
and is joined back on ``(group, chunk)``.  The big side is shuffled once on
``(group, chunk)``; the join reuses that partitioning, and AQE decides at run
time whether the chunk table is small enough to broadcast.

Where a clock unit may be crowded (all sessions together, or values instead of
times), ``range_chunks`` cuts the chunks by the data: Spark's range partitioner
draws the borders from a sample of the whole order, so rows with equal times
are cut too, and each row keeps the chunk that was written down with it.  The
scans take those chunks as they are.

Rows are ordered by ``(ts ASC NULLS LAST, tie)``; rows without a timestamp
form the last chunk of their group.  The group key is one struct column, so
null key parts group together (as dplyr does) and joins stay plain equi-joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telespark.functions.time import unit_chunk
from telespark.session import written

KEY = "_k"
CHUNK = "_ch"
#: Rows of a chunk that the data cut.
CHUNK_ROWS = 1_000_000


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in keys]) if keys else F.struct(F.lit(0).alias("all"))


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int | None = None) -> DataFrame:
    """Add the group key and chunks of about ``rows`` rows along (keys, order).

    The table is written twice, with its chunk the second time, so a chunk
    never changes when a task is repeated; up to ``rows`` rows are one chunk
    and are written once.  ``order`` has to tell rows apart where they could
    crowd."""
    return cut(df, keys, order, rows)[0]


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int | None = None) -> tuple[DataFrame, int]:
    """``range_chunks`` and the number of chunks."""
    rows = CHUNK_ROWS if rows is None else rows
    d = written(df.withColumn(KEY, _key(keys)), "ordered")
    n = -(-d.count() // rows)
    if n <= 1:
        return d.withColumn(CHUNK, F.lit(0)), 1
    return written(d.repartitionByRange(n, KEY, *order).withColumn(CHUNK, F.spark_partition_id()), "chunks"), n


def ranked(df: DataFrame, key: str, value: str, rows: int | None = None) -> DataFrame:
    """Add each value's ``place`` in its group (from 1; values are distinct in a group), and the group's count ``n``,
    least ``_lo`` and greatest ``_hi``.  A table of one chunk is ranked by windows, a larger one chunk by chunk."""
    d, chunks = cut(df, [key], [F.col(value)], rows)
    if chunks == 1:
        own = Window.partitionBy(key)
        return drop_scan_keys(d.withColumns({"place": F.row_number().over(own.orderBy(value)), "n": F.count(F.lit(1)).over(own), "_lo": F.min(value).over(own), "_hi": F.max(value).over(own)}))
    ends = d.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("n"))
    return row_numbers(d, [key], value, value, "place", "total").drop("total").join(ends, key)


def with_scan_keys(df: DataFrame, keys: Sequence[str], ts: str, unit: str) -> DataFrame:
    """Add the struct group key ``_k`` and the chunk id ``_ch`` (idempotent)."""
    if KEY not in df.columns:
        df = df.withColumn(KEY, _key(keys))
    if CHUNK not in df.columns:
        df = df.withColumn(CHUNK, unit_chunk(ts, unit))
    return df


def drop_scan_keys(df: DataFrame) -> DataFrame:
    return df.drop(KEY, CHUNK)


def order_key(ts: str, tie: str) -> Column:
    """Sortable struct giving the row order (null timestamps last)."""
    return F.struct(F.col(ts).isNull().alias("n"), F.col(ts).alias("t"), F.col(tie).alias("r"))


def _in_chunk(ts: str, tie: str):
    return Window.partitionBy(KEY, CHUNK).orderBy(F.col(ts).asc_nulls_last(), F.col(tie))


def _chunks():
    return Window.partitionBy(KEY).orderBy(CHUNK)


def _join_chunks(df: DataFrame, chunks: DataFrame) -> DataFrame:
    return df.join(chunks, [KEY, CHUNK], "left")


def shift(df: DataFrame, keys: Sequence[str], ts: str, tie: str, cols: dict[str, str],
          *, lead: bool = False, unit: str = "hour") -> DataFrame:
    """``lag``/``lead`` by one row within each group, across chunk borders.

    ``cols`` maps source column -> output column.  The first (last) row of a
    group gets null, as R's ``lag``/``lead``.
    """
    d = with_scan_keys(df, keys, ts, unit)
    w = _in_chunk(ts, tie)
    fn = F.lead if lead else F.lag
    edge = "_edge"
    d = d.withColumn(edge, fn(F.lit(1)).over(w).isNull())
    for src, out in cols.items():
        d = d.withColumn(out, fn(F.col(src)).over(w))
    ok = order_key(ts, tie)
    vals = F.struct(*[F.col(src).alias(out) for src, out in cols.items()])
    pick = F.min_by(vals, ok) if lead else F.max_by(vals, ok)
    nb = "_nb"
    chunks = (with_scan_keys(df, keys, ts, unit)
              .groupBy(KEY, CHUNK).agg(pick.alias("_b"))
              .withColumn(nb, fn(F.col("_b")).over(_chunks()))
              .select(KEY, CHUNK, nb))
    d = _join_chunks(d, chunks)
    d = d.withColumns({out: F.when(F.col(edge), F.col(f"{nb}.{out}")).otherwise(F.col(out))
                       for out in cols.values()})
    return d.drop(edge, nb)


def running_sum(df: DataFrame, keys: Sequence[str], ts: str, tie: str, col: str, out: str,
                *, strict: bool = True, unit: str = "hour") -> DataFrame:
    """``cumsum(x)`` per group.  With ``strict`` a null poisons the rest of the
    group, as R's ``cumsum`` does; otherwise nulls are skipped."""
    d = with_scan_keys(df, keys, ts, unit)
    w = _in_chunk(ts, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = F.col(col)
    d = d.withColumns({"_ls": F.sum(x).over(w),
                       "_ln": F.max(x.isNull().cast("int")).over(w)})
    before = _chunks().rowsBetween(Window.unboundedPreceding, -1)
    chunks = (with_scan_keys(df, keys, ts, unit)
              .groupBy(KEY, CHUNK)
              .agg(F.coalesce(F.sum(x), F.lit(0)).alias("_t"),
                   F.max(x.isNull().cast("int")).alias("_n"))
              .withColumns({"_ps": F.coalesce(F.sum("_t").over(before), F.lit(0)),
                            "_pn": F.coalesce(F.max("_n").over(before), F.lit(0))})
              .select(KEY, CHUNK, "_ps", "_pn"))
    d = _join_chunks(d, chunks)
    total = F.col("_ps") + F.coalesce(F.col("_ls"), F.lit(0))
    if strict:
        total = F.when((F.col("_pn") + F.col("_ln")) > 0, F.lit(None)).otherwise(total)
    return d.withColumn(out, total).drop("_ls", "_ln", "_ps", "_pn")


def row_numbers(df: DataFrame, keys: Sequence[str], ts: str, tie: str, number: str, total: str,
                *, unit: str = "hour") -> DataFrame:
    """Row number within each group in (ts, tie) order, and the group's rows:
    numbered inside chunks, shifted by the rows of the chunks before."""
    d = with_scan_keys(df, keys, ts, unit)
    before = _chunks().rowsBetween(Window.unboundedPreceding, -1)
    chunks = (d.groupBy(KEY, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
              .select(KEY, CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                      F.sum("_n").over(Window.partitionBy(KEY)).alias(total)))
    d = _join_chunks(d.withColumn("_r", F.row_number().over(_in_chunk(ts, tie))), chunks)
    return drop_scan_keys(d.withColumn(number, F.col("_before") + F.col("_r"))).drop("_before", "_r")


def fill_down(df: DataFrame, keys: Sequence[str], ts: str, tie: str, col: str, out: str,
              *, unit: str = "hour", source: DataFrame | None = None,
              chunk_index: DataFrame | None = None) -> DataFrame:
    """``tidyr::fill(.direction="down")``: last non-null value carried forward.

    By default the chunk table is built from ``df`` itself.  For a large
    generated input whose own values are mostly null, pass ``source`` (the
    rows that can hold a non-null value, with ``keys, ts, tie, col``) and
    ``chunk_index`` (``keys`` plus ``_ch``, covering every chunk of ``df``):
    the input is then not computed twice."""
    d = with_scan_keys(df, keys, ts, unit)
    w = _in_chunk(ts, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_lf", F.last(F.col(col), ignorenulls=True).over(w))
    x = F.col(col)
    before = _chunks().rowsBetween(Window.unboundedPreceding, -1)
    if source is None:
        # every chunk of df, with its last non-null value (or none)
        last = (with_scan_keys(df, keys, ts, unit).groupBy(KEY, CHUNK)
                .agg(F.max_by(x, F.when(x.isNotNull(), order_key(ts, tie))).alias("_cl")))
    else:
        src = source.select(*keys, ts, tie, col).filter(x.isNotNull())
        last = (with_scan_keys(src, keys, ts, unit).groupBy(KEY, CHUNK)
                .agg(F.max_by(x, order_key(ts, tie)).alias("_cl")))
    if chunk_index is not None:
        idx = with_scan_keys(chunk_index, keys, ts, unit).select(KEY, CHUNK)
        every = idx.unionByName(last.select(KEY, CHUNK)).distinct()
        last = every.join(last, [KEY, CHUNK], "left")
    elif source is not None:
        raise ValueError("a separate source needs a chunk_index covering df")
    chunks = (last.withColumn("_pf", F.last("_cl", ignorenulls=True).over(before))
              .select(KEY, CHUNK, "_pf"))
    d = _join_chunks(d, chunks)
    return d.withColumn(out, F.coalesce(F.col("_lf"), F.col("_pf"))).drop("_lf", "_pf")


def group_min(df: DataFrame, keys: Sequence[str], ts: str, exprs: dict[str, Column],
              *, unit: str = "hour") -> DataFrame:
    """Attach ``min(expr)`` over the whole group to every row (an un-ordered
    grouped ``mutate``) without re-shuffling rows on the group key alone:
    minima per chunk, then per group over the chunk table."""
    d = with_scan_keys(df, keys, ts, unit)
    grp = Window.partitionBy(KEY)
    chunks = (d.groupBy(KEY, CHUNK)
              .agg(*[F.min(e).alias(n) for n, e in exprs.items()])
              .withColumns({n: F.min(n).over(grp) for n in exprs}))
    return _join_chunks(d, chunks)
