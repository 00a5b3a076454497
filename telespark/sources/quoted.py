"""Records of delimited files whose quoted fields hold line breaks.

Whether a line starts inside a quoted field depends on all lines before it.
But a line by itself says what it does to either state - outside or inside a
quoted field - so it is a function on two states, and functions compose in
any grouping.  Every line gets its function where it is read; each file split
is scanned for its own composition; a table with one row for each split
carries the state from split to split.  Splits are never joined into one task.

A quote opens a field only as the field's first character, a doubled quote
inside is text, and what follows the closing quote up to the delimiter is text
(quotes included).  A field that is never closed opens no record: its lines
stay records of their own.  Line breaks inside a field come back as ``\\n``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telespark.session import written

PLACE = ["path", "split"]


def with_states(lines: DataFrame, sep: str) -> DataFrame:
    """Add ``from_outside`` and ``from_inside``: is the next line inside a quoted field (1), if this one starts outside or inside one?"""
    s = re.escape(sep)
    text = '[^"]*+(?:""[^"]*+)*+'  # of a quoted field, up to a quote that stands alone or to the end
    fields = f'(?:(?:"{text}"[^{s}]*+|[^"{s}][^{s}]*+)?{s})*+'
    opens = f'{fields}"{text}$'
    value, has_quote = F.col("value"), F.col("value").contains('"')
    outside = F.when(has_quote, value.rlike("^" + opens)).otherwise(F.lit(False))
    inside = F.when(has_quote, value.rlike(f'^{text}(?:$|"[^{s}]*+{s}{opens})')).otherwise(F.lit(True))
    return lines.withColumns({"from_outside": outside.cast("int"), "from_inside": inside.cast("int")})


def _compose(swap: Column, fixed: Column, window) -> tuple[Column, Column]:
    """Running composition: (parity of the swaps so far, what the last line with a fixed outcome adds to it; null: none yet)."""
    swaps = F.sum(swap).over(window)
    return swaps, F.last(F.when(fixed.isNotNull(), (fixed + swaps) % 2), ignorenulls=True).over(window)


def records(lines: DataFrame) -> DataFrame:
    """Lines (value, path, split, row, ...) as records: the lines of one record are joined at the place of its first.

    Files in which no line opens a field that it does not close keep their lines as they are, without a shuffle."""
    plain = [c for c in lines.columns if not c.startswith("from_")]
    odd_files = lines.where("from_outside = 1").select("path").distinct()
    if odd_files.isEmpty():
        return lines.select(*plain)
    odd = lines.join(odd_files, "path", "left_semi")

    # Inside each split, then from split to split.
    up = Window.partitionBy(*PLACE).orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outcome = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside"))
    swap = (F.col("from_outside") > F.col("from_inside")).cast("int")
    swaps, fixed = _compose(swap, outcome, up)
    odd = written(odd.withColumns({"swaps": swaps, "fixed": fixed}), "quoted-lines")
    splits = odd.groupBy(*PLACE).agg(F.max_by(F.struct("swaps", "fixed"), "row").alias("s"))
    by_split = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = F.when(F.col("s.fixed").isNotNull(), (F.col("s.fixed") + F.col("s.swaps")) % 2)
    swaps, fixed = _compose(F.when(out.isNull(), F.col("s.swaps") % 2).otherwise(0), out, by_split)
    after = (F.coalesce(fixed, F.lit(0)) + swaps) % 2
    in_order = Window.partitionBy("path").orderBy("split")
    splits = splits.select(*PLACE, after.alias("after")).select(
        *PLACE, F.coalesce(F.lag("after").over(in_order), F.lit(0)).alias("at_start"),
        F.last("after").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("at_end"))
    order = Window.partitionBy(*PLACE).orderBy("row")
    after = (F.coalesce("fixed", "at_start") + F.col("swaps")) % 2
    odd = odd.join(splits, PLACE).withColumn("after", after).withColumn("before", F.coalesce(F.lag("after").over(order), F.col("at_start")))

    # The record of a line starts at the last line before it that starts outside.
    here = F.when(F.col("before") == 0, F.struct("split", "row"))
    odd = written(odd.withColumn("start", F.last(here, ignorenulls=True).over(order)), "quoted-starts")
    last = odd.groupBy(*PLACE).agg(F.max("start").alias("s"))
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = last.select(*PLACE, F.last("s", ignorenulls=True).over(earlier).alias("carried"), F.last("s", ignorenulls=True).over(whole).alias("of_file"))
    odd = odd.join(last, PLACE).withColumn("start", F.coalesce("start", "carried"))
    never_closed = (F.col("at_end") == 1) & (F.col("start") == F.col("of_file"))
    alone = never_closed | ((F.col("before") == 0) & (F.col("after") == 0))
    single = odd.where(alone).select(*plain)
    rest = [c for c in plain if c not in ("value", "split", "row", "path")]
    joined = odd.where(~alone).groupBy("path", "start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "row", "value"))), lambda x: x["value"]), "\n").alias("value"),
        *(F.first(c).alias(c) for c in rest)).select(*(F.col("start")[c].alias(c) if c in ("split", "row") else F.col(c) for c in plain))
    return lines.join(odd_files, "path", "left_anti").select(*plain).unionByName(single).unionByName(joined)
