"""Shards of equal row counts that keep linked documents together, by balanced label propagation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, whole_text

#: Rounds of label propagation at most; a round that moves less than this share of the linked rows changes the mode or ends.
ROUNDS, SETTLED = 14, 0.005
#: Buckets of equal priority inside a size class of proposals.
BUCKETS = 16


def text_group() -> Column:
    """Documents with equal texts are linked: the 128-bit hash of the text."""
    return F.unhex(F.md5(whole_text()))


def _numbered(rows: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Gapless numbers from 0 within ``keys``: rows are numbered inside (keys, part), and the counts of the parts
    before are added.  No window holds more rows than one part of the input, or more counts than there are parts."""
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "part").agg(F.count("*").alias("_n"))
    counts = counts.select(*keys, "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("i")) - 1
    return rows.withColumn("_inside", inside).join(counts, [*keys, "part"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_inside", "_before")


def _proposals(cells: DataFrame, open_shards: Sequence[int], turn: int) -> DataFrame:
    """(h, a, b, n, class, bucket): the n rows of group h in shard a want to its fullest open shard b.

    Ties go by a hash that changes every turn, so requests between two shards even out.  A cell never moves to a smaller one, so every move lowers the cut."""
    liked = F.xxhash64("h", "shard", F.lit(turn))
    is_open = F.col("shard").isin(list(open_shards))
    best = cells.where(is_open).groupBy("h").agg(F.max(F.struct("n", liked.alias("liked"), "shard")).alias("best"))
    joined = cells.withColumnRenamed("n", "own").join(best, "h")
    to, size = F.col("best.shard"), F.col("best.n")
    return joined.where((F.col("shard") != to) & (F.col("own") <= size)).select(
        "h", F.col("shard").alias("a"), to.alias("b"), F.col("own").alias("n"),
        F.floor(F.log2(size + F.col("own"))).cast("int").alias("class"), F.pmod(F.xxhash64("h", F.lit(1)), F.lit(BUCKETS)).cast("int").alias("bucket"))


def _quotas(wanted: dict[tuple[int, int], int], room: Sequence[int]) -> dict[tuple[int, int], int]:
    """Rows that may move from a to b: as many as come back from b to a, and a share of the room that b has."""
    quota = {ab: min(n, wanted.get(ab[::-1], 0)) for ab, n in wanted.items()}
    for b, free in enumerate(room):
        unmet = {ab: n - quota[ab] for ab, n in wanted.items() if ab[1] == b and n > quota[ab]}
        total = sum(unmet.values())
        for ab, n in unmet.items():
            share = min(n, max(0, free) * n // total)
            quota[ab], unmet[ab] = quota[ab] + share, n - share
            free -= share
            total -= n  # what rounding leaves goes to the later ones
    return quota


def propagate(cells: DataFrame, capacity: Sequence[int], rounds: int = ROUNDS) -> DataFrame:
    """(h, shard, n) after balanced label propagation of the linked rows.

    ``cells`` has (h, shard, n): the n rows of group h that are in a shard now; rows of one group in one shard are
    alike, so a group of any size is one row a shard.  Each round joins the cells with their group's fullest shard;
    a cell asks to move there, and the quotas of each pair of shards let through the requests of the largest groups
    first, the last bucket in proportion (rounded up or down by a hash).  While swaps are worth it every shard is open, then only shards with room.
    The driver sees loads and requests of pairs of shards.  Every round is written to the shared folder.
    """
    shards, every = len(capacity), list(range(len(capacity)))
    swaps = True
    for turn in range(rounds):
        load = dict.fromkeys(every, 0) | {r[0]: r[1] for r in cells.groupBy("shard").agg(F.sum("n")).collect()}
        total, room = sum(load.values()), [capacity[s] - load[s] for s in every]
        open_shards = every if swaps else [s for s in every if room[s] > 0]
        if not total or not open_shards:
            break
        asked = materialise(_proposals(cells, open_shards, turn), "asked")
        wanted = {(r["a"], r["b"]): r["n"] for r in asked.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}
        quota = {ab: q for ab, q in _quotas(wanted, room).items() if q}
        if sum(quota.values()) > SETTLED * total or (quota and not swaps):
            allowed = F.element_at(F.create_map(*(F.lit(x) for (a, b), q in quota.items() for x in (a * shards + b, q))), F.col("a") * shards + F.col("b"))
            order = Window.partitionBy("a", "b").orderBy(F.col("class").desc(), "bucket")
            buckets = asked.groupBy("a", "b", "class", "bucket").agg(F.sum("n").alias("all")).select(
                "a", "b", "class", "bucket", "all", (F.sum("all").over(order) - F.col("all")).alias("before"), F.coalesce(allowed, F.lit(0)).cast("long").alias("quota"))
            left = F.col("quota") - F.col("before")
            up = F.pmod(F.xxhash64("h", "a", F.lit(2)), F.lit(1 << 20)) / (1 << 20)
            moved = F.when(left >= F.col("all"), F.col("n")).otherwise(F.floor(F.col("n") * (left / F.col("all")) + up))
            moves = asked.join(buckets.where("before < quota"), ["a", "b", "class", "bucket"]).select("h", "a", "b", moved.cast("long").alias("m")).where("m > 0")
            ends = moves.select("h", F.explode(F.array(F.struct(F.col("a").alias("shard"), (-F.col("m")).alias("n")), F.struct(F.col("b").alias("shard"), F.col("m").alias("n")))).alias("e"))
            cells = materialise(cells.select("h", "shard", "n").unionByName(ends.select("h", "e.shard", "e.n")).groupBy("h", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "cells")
        if sum(quota.values()) <= SETTLED * total:
            if not swaps:
                break
            swaps = False
    return cells


def shard(docs: DataFrame, shards: int = 8, group: Column | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs, by the law ``rows``:
    the counts of the shards are at most one apart.

    Rows with an equal ``group`` value (default: equal texts; null counts as empty) are linked.  Linked rows start
    spread evenly over the shards and move to their neighbours (``propagate``); rows without a link, and rows beyond
    a shard's count, fill what is left, which makes the law hold exactly.  A group larger than a shard fills shards
    one after another.  ``slot`` numbers the rows of a shard from 0.  ``grown_shard`` belongs to another law and is null.

    Rows that repeat an id or a whole row are separate rows; null ids are kept.  Rows are told apart by the file
    split and the place in it at which they are read, which are written down once, before anything depends on them.
    An empty table gives no rows; other columns are not read, texts do not move.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
                       (text_group() if group is None else group).alias("h"))
    rows = materialise(rows.withColumns({"part": F.spark_partition_id(), "i": F.monotonically_increasing_id()}), "rows")
    groups = materialise(rows.groupBy("h").agg(F.count("*").alias("members")).where("members > 1 AND h IS NOT NULL"), "groups")
    n = rows.count()
    capacity = [n // shards + (s < n % shards) for s in range(shards)]

    # A group's rows start on consecutive shards from a hashed one: a full circle gives each shard the same.
    turn = F.pmod(F.col("shard") - F.pmod(F.xxhash64("h"), F.lit(shards)), F.lit(shards))
    cells = groups.select("h", "members", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    cells = cells.select("h", "shard", (F.floor(F.col("members") / shards) + (turn < F.col("members") % shards).cast("long")).alias("n")).where("n > 0")
    cells = propagate(materialise(cells, "cells"), capacity, rounds)

    # Members of a group take its shards in order: the shard of a member is the number of bounds at or below its number.
    bounds = cells.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("m"))
    upto, total = [], F.lit(0).cast("long")
    for s in range(shards):
        total = total + F.coalesce(F.element_at("m", s), F.lit(0))
        upto.append(total)
    bounds = bounds.select("h", F.array(*upto).alias("upto"))
    linked = _numbered(rows.join(bounds, "h"), ["h"], "member")
    linked = linked.withColumn("kind", F.size(F.filter("upto", lambda b: b <= F.col("member"))))
    loose = rows.join(groups.select("h"), "h", "left_anti").withColumn("kind", F.lit(shards))
    columns = ["doc_id", "size", "text_crc32", "part", "i", "kind"]
    dealt = materialise(linked.select(*columns).unionByName(loose.select(*columns)), "dealt")

    load = dict.fromkeys(range(shards + 1), 0) | {r[0]: r[1] for r in dealt.groupBy("kind").count().collect()}
    kept = [min(load[s], capacity[s]) for s in range(shards)]
    numbered = _numbered(dealt, ["kind"], "no")

    def by_kind(values: Sequence[int]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("kind") + 1).cast("long")

    first_free = [load[shards] + sum(load[x] - kept[x] for x in range(s)) for s in range(shards)] + [0]
    free = F.col("no") - by_kind([*kept, 0]) + by_kind(first_free)  # place among the rows that fill up
    stays = F.col("no") < by_kind([*kept, 0])
    gaps = [sum(capacity[x] - kept[x] for x in range(s + 1)) for s in range(shards)]  # cumulative room
    fills = F.size(F.filter(F.array(*(F.lit(g).cast("long") for g in gaps)), lambda g: g <= F.col("free")))
    out = numbered.withColumns({"stays": stays, "free": free}).withColumn("shard", F.when(F.col("stays"), F.col("kind")).otherwise(fills).cast("int"))
    start = F.element_at(F.array(*(F.lit(k - g).cast("long") for k, g in zip(kept, [0, *gaps]))), F.col("shard") + 1)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.when(F.col("stays"), F.col("no")).otherwise(start + F.col("free")).alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))
