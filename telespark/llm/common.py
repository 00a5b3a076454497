"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telespark.session import scratch_path

#: Gaps between words.  The words of a text are the runs of other characters.
GAP = r"[\x20\x09-\x0D]+"
_GAP_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole_text(col: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else.  Pure ASCII texts take the fast way."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words(c: Column) -> Column:
    """Array of the words of a text (empty for a text without words)."""
    trimmed = F.btrim(c, F.lit(_GAP_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back: lineage ends there.

    Later stages read the files whatever executors are lost.  The folder is
    the cluster's ``spark.checkpoint.dir``; its tables go when it is cleaned.
    """
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_share(h: Column, wanted: int, n: int) -> Column:
    """Is the 64-bit hash among the lowest of ``n``?  True for ``wanted`` of them, and ten deviations more.

    An ordered limit after it sees about ``wanted`` rows, however many there are.
    """
    share = (wanted + 10 * wanted**0.5) / max(n, 1)
    return F.lit(True) if share >= 1 else h <= F.lit(int(-(1 << 63) + share * (1 << 64)))
