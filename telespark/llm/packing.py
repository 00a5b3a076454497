"""Best-fit packing of token counts into bins of several permitted sizes."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Permitted sequence lengths, and the fixed cost of a sequence in tokens.
SIZES, OVERHEAD = (256, 512, 1024, 2048, 4096), 16
#: Pieces that one task packs, about, and copies of a row that one step unfolds.
GROUP_ROWS, COPIES = 8192, 65536


def pack(lengths: Sequence[int], sizes: Sequence[int] = SIZES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, start inside it, final size of each bin).

    Pieces in falling order go where the least room is left after them.  When
    no open bin has room, the bin size with the least cost for a token it will
    hold is opened: a bin costs its size and ``overhead``, and may expect, up to
    its size, the later pieces that fit beside this one and that no room is
    open for yet.  In the end each bin shrinks to the smallest size that holds
    its contents.  Every length is between 1 and the largest size.
    """
    sizes = sorted(sizes)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    falling = [lengths[i] for i in order]
    rising = falling[::-1]
    below = [0]  # tokens of the k smallest pieces
    for n in rising:
        below.append(below[-1] + n)
    where, start, used, size = [0] * len(lengths), [0] * len(lengths), [], []
    room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]  # open bins by what is left
    some, free = 0, 0  # bit k: room[k] is not empty; all open room
    for rank, i in enumerate(order):
        n = lengths[i]
        later = len(order) - rank - 1
        fits = some >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                some &= ~(1 << left)
            free -= left
        else:
            def cost(c: int) -> float:
                expected = below[min(later, bisect_left(rising, c - n + 1))] - free
                return (c + overhead) / (n + max(0, min(c - n, expected)))

            left = min((c for c in sizes if c >= n), key=cost)
            b = len(used)
            used.append(0)
            size.append(left)
        where[i], start[i] = b, used[b]
        used[b] += n
        left -= n
        if left:
            room[left].append(b)
            some |= 1 << left
            free += left
    return where, start, [sizes[bisect_left(sizes, u)] for u in used]


def _pack_task(sizes: Sequence[int], overhead: int):
    schema = "doc_id long, piece int, n_tokens long, bin_id long, bin_size int, bin_used long, bin_start long"

    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        n = t.column("n_tokens").to_numpy()
        full = np.flatnonzero(n > 0)
        where, start, size = pack(n[full].tolist(), sizes, overhead)
        where = np.array(where, np.int64)
        used = np.bincount(where, n[full], len(size)).astype(np.int64)
        base = t.column("part")[0].as_py() << 32
        at = np.full(len(n), -1, np.int64)  # pieces without tokens are in no bin
        at[full] = np.arange(len(full))
        take = lambda x, kind: pa.array([None if k < 0 else int(x[k]) for k in at], kind)
        out = {"doc_id": t.column("doc_id"), "piece": t.column("piece"), "n_tokens": t.column("n_tokens"), "bin_id": take(base + where, pa.int64()),
               "bin_size": take(np.array(size, np.int64)[where], pa.int32()), "bin_used": take(used[where], pa.int64()), "bin_start": take(start, pa.int64())}
        yield from pa.table(out).to_batches()

    return run, schema


def best_fit(docs: DataFrame, tokens: Column, sizes: Sequence[int] = SIZES, overhead: int = OVERHEAD, id_col: str = "doc_id") -> DataFrame:
    """A row for each piece: (doc_id, piece, n_tokens, bin_id, bin_size, bin_used, bin_start).

    Documents over the largest size are cut into pieces of that size and a
    rest.  Pieces are dealt out by a hash of id, piece, length and number of the
    copy, and each task packs about ``GROUP_ROWS`` pieces with ``pack``: memory is
    bounded for any text, and the same rows give the same bins however the
    files are split.  Only ids and counts move.  A document without
    tokens (a null or negative count is 0) has one row and no bin.
    Repeated rows are packed each, null ids too.  An empty table gives an empty
    result.
    """
    if min(sizes) < 1:
        raise ValueError("sizes are positive")
    top = max(sizes)
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    counted = materialise(counted.groupBy("doc_id", "n").agg(F.count("*").alias("copies")).withColumn("last", F.greatest(F.ceil(F.col("n") / top) - 1, F.lit(0)).cast("int")), "counted")
    groups = max(1, -(-(counted.agg(F.sum(F.col("copies") * (F.col("last") + 1))).first()[0] or 0) // GROUP_ROWS))
    # Copies in two steps, so that no array grows with the number of rows that repeat.
    pieces = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("copies") - 1).cast("long") - (F.col("copies") - 1) % COPIES, F.lit(COPIES).cast("long"))))
    pieces = pieces.withColumn("copy", F.explode(F.sequence(F.col("block"), F.least(F.col("copies"), F.col("block") + COPIES) - 1)))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("last"))))
    pieces = pieces.select("doc_id", "piece", "copy", F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece").cast("long") * top).alias("n_tokens"))
    dealt = pieces.repartition(groups, F.xxhash64("doc_id", "piece", "copy", "n_tokens")).sortWithinPartitions(F.desc("n_tokens"), "doc_id", "piece", "copy")
    run, schema = _pack_task(tuple(sizes), overhead)
    return dealt.select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "piece", "n_tokens").mapInArrow(run, schema)
