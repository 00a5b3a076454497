"""Exact duplicates by 128-bit content hash, with a byte comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telespark.operators import existence

from .common import ascii_lower, materialise, whole_text


def content_hash(text: Column) -> Column:
    """128-bit hash of a text."""
    return F.unhex(F.md5(text))


def _collided(texts: DataFrame, repeated: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """The hashes of ``repeated`` (h) that stand for texts (t) whose bytes differ: none, as a rule.

    Only texts whose hash repeats are compared, and move for it (a filter of
    the repeated hashes refuses most others where they stand).  Equal texts of
    a task become one before the shuffle.
    """
    suspects = existence.flag(texts.select(digest(F.col("t")).alias("h"), "t"), "h", repeated, "_repeated").where("_repeated")
    return suspects.groupBy("h", "t").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h")


def exact_duplicates(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs.

    Texts are equal when identical after folding A-Z; null counts as empty.
    Rows are grouped on the hash of their text, counted inside each task before
    the shuffle, so a group of any size adds one row per task.  The bytes of
    texts whose hash repeats are compared.  Where they are all equal, the
    group stands; the rows of a hash that they differ in are grouped on hash
    and text, so texts that only share the hash fall apart.  Texts whose hash
    occurs once never move.

    ``keep``: the smallest or the largest id of the group stays.  Rows that
    repeat an id inside a group are kept or dropped together.  Null ids count
    in ``group_size`` and stay only when all ids of the group are null.  An
    empty table gives an empty result; other columns are not read.
    ``digest`` makes the hash; any weaker one gives the same result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    pick = F.min if keep == "smallest" else F.max
    text = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(whole_text(text_col)).alias("t"))
    rows = materialise(text.select("doc_id", digest(F.col("t")).alias("h"), F.unhex(F.sha2("t", 256)).alias("sha")), "digests")
    groups = materialise(rows.groupBy("h").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    collided = materialise(_collided(text, groups.where("group_size > 1").select("h"), digest), "collided")
    plain = rows.join(groups, "h")
    if not collided.isEmpty():
        plain = plain.join(collided, "h", "left_anti")
        apart = text.select("doc_id", "t", digest(F.col("t")).alias("h")).join(collided, "h", "left_semi")
        own = apart.groupBy("h", "t").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        apart = apart.join(own, ["h", "t"]).withColumn("sha", F.unhex(F.sha2("t", 256))).drop("t")
        plain = plain.unionByName(apart)
    return plain.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each distinct text (as above), with the columns of docs.

    Of rows that tie on the kept id, the smallest (or largest) row stays; a
    null id stays only when there is no other.  Rows whose hash occurs once
    stay where they are; the others meet by hash and text.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    text = docs.select(F.struct(*docs.columns).alias("row"), ascii_lower(whole_text(text_col)).alias("t")).withColumn("h", content_hash(F.col("t")))
    repeated = materialise(text.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    flagged = existence.flag(text, "h", repeated, "again")
    missing, pick = F.col(f"row.{id_col}").isNull(), F.min
    if keep == "largest":
        missing, pick = ~missing, F.max
    best = pick(F.struct(missing.alias("missing"), F.col(f"row.{id_col}").alias("id"), F.col("row"))).alias("best")
    copies = flagged.where("again").groupBy("h", "t").agg(best).select("best.row")
    return flagged.where("not again").select("row").unionByName(copies).select("row.*")
