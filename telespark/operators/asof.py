"""Ceiling as-of join: for each value the smallest level at or above it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telespark.functions.nulls import nan_to_null
from telespark.operators import ordered
from telespark.operators.ordered import CHUNK, KEY


def ceiling_join(df: DataFrame, value: str, levels: DataFrame, level: str, take: Sequence[str], *,
                 tie: str, first: str | None = None, rows: int | None = None) -> DataFrame:
    """``df`` with the columns ``take`` of the smallest level >= ``value``; null where there is none.

    Values and levels are merged in one order: both are cut into ranges of
    about ``rows`` rows along (value, values before levels, tie), each range is
    scanned backwards for the nearest level, and a table with one row for each
    range carries the first level of the later ranges back.  No range holds
    all rows of a frequent value if ``tie`` tells them apart, and any number
    of levels will do.

    Of equal levels the one with the smallest ``first`` counts (without it,
    the smallest ``take``).  Missing and NaN values get null, missing and NaN
    levels count for nothing; every row of ``df`` comes back once.
    """
    v, lv = nan_to_null(F.col(value).cast("double")), nan_to_null(F.col(level).cast("double"))
    order = F.struct(*([first] if first else []), *take)
    table = levels.select(lv.alias("_v"), F.struct(*take).alias("_take"), order.alias("_o")).where("_v IS NOT NULL")
    table = table.groupBy("_v").agg(F.min_by("_take", "_o").alias("_take")).withColumn("_level", F.lit(True))
    rest = df.withColumns({"_v": v, "_level": F.lit(False), "_tie": F.xxhash64(tie)})
    merged = rest.unionByName(table, allowMissingColumns=True)
    key = [F.col("_v").asc_nulls_last(), F.col("_level"), F.col("_tie").asc_nulls_last()]
    d = ordered.range_chunks(merged, (), key, rows)
    # Scanned from the last row back, so that each frame grows by one row.
    back = Window.partitionBy(KEY, CHUNK).orderBy(F.col("_v").desc_nulls_first(), F.col("_level").desc(), F.col("_tie").desc_nulls_first())
    d = d.withColumn("_next", F.last(F.when(F.col("_level"), F.col("_take")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    heads = d.groupBy(KEY, CHUNK).agg(F.min_by("_take", F.when(F.col("_level"), F.col("_v"))).alias("_head"))
    later = Window.partitionBy(KEY).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(KEY, CHUNK, F.last("_head", ignorenulls=True).over(later).alias("_later"))
    d = d.join(heads, [KEY, CHUNK], "left").where(~F.col("_level"))
    found = F.when(F.col("_v").isNotNull(), F.coalesce("_next", "_later"))
    return d.select(*df.columns, *(found[c].alias(c) for c in take))
