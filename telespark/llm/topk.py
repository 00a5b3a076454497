"""Exact top-k inner products with the threshold algorithm on sorted lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Vectors in a block of candidates, and queries in a block of queries.
CANDIDATES, QUERIES = 4096, 1024
#: List entries that one round of sorted access reads in each dimension, doubled every round.
STEP = 8
#: Doubles are exact below this; larger products are Python's integers.
EXACT = 2**53


def threshold_topk(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, k: int, lists: np.ndarray, sorted_values: np.ndarray, skip: int | None = None, floor: float | None = None) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, row) of a block by Fagin's threshold algorithm, and how many list entries were read.

    ``lists[d]`` holds the rows by falling value of dimension d and
    ``sorted_values[d]`` the values.  Dimensions with a negative query weight
    are read from the other end.  Every row met in a list is scored in full;
    a row not met scores at most the sum of the last values read, so reading
    stops once that bound is below the k-th score, or below ``floor``, a score
    that k rows elsewhere reach (equal scores could still win by a smaller
    id).  ``skip`` is the place of the query's own row.
    """
    n, dims = vectors.shape
    score = np.zeros(n, vectors.dtype)
    met = np.zeros(n, bool)
    used = np.flatnonzero(query)
    down = query[used] > 0
    depth, step = 0, STEP
    best = np.zeros(0, np.int64)
    if not len(used):  # all scores are 0: ties go by id alone
        met[:] = True
        depth = n
    while True:
        stop = min(n, depth + step)
        if depth < n:
            rows = np.concatenate([lists[used[down], depth:stop].ravel(), lists[used[~down], n - stop : n - depth].ravel()])
            new = np.unique(rows[~met[rows]])
            met[new] = True
            score[new] = vectors[new] @ query
            best = np.concatenate([best, new])
        elif not len(best):
            best = np.flatnonzero(met)
        if skip is not None:
            best = best[best != skip]
        best = best[np.lexsort((ids[best], -score[best]))][:k]
        if stop >= n:
            break
        least = [x for x in (floor, score[best[-1]] if len(best) == k else None) if x is not None]
        last = np.where(down, sorted_values[used, stop - 1], sorted_values[used, n - stop])
        if least and (last * query[used]).sum() < max(least):
            break
        depth, step = stop, step * 2
    return [(int(score[i]), int(i)) for i in best], len(used) * stop


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length, a row each."""
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy().reshape(len(flat), -1)


LISTS = "dims int, block int, ids binary, copies binary, vectors binary, lists binary"


def _sorted_lists(rows: pa.Table) -> pa.Table:
    """A block as one row: its ids and vectors, and for each dimension its rows by falling value."""
    vectors = _matrix(rows.column("v"))
    parts = (rows.column("vec_id").to_numpy(), rows.column("copy").to_numpy(), vectors, np.argsort(-vectors.T, axis=1, kind="stable").astype(np.int32))
    head = [pa.array([rows.column(c)[0].as_py()], pa.int32()) for c in ("dims", "block")]
    return pa.table(head + [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts], names=[c.split()[0] for c in LISTS.split(", ")])


FOUND = "query_id long, query_copy long, vec_id long, copy long, score long, read long, entries long"


def _search(k: int):
    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in FOUND.split(", ")]
        out: list[tuple] = []
        if queries.num_rows and blocks.num_rows:
            ids, copies, vectors, lists = (np.frombuffer(blocks.column(c)[0].as_buffer(), t) for c, t in (("ids", np.int64), ("copies", np.int64), ("vectors", np.int64), ("lists", np.int32)))
            vectors, lists = vectors.reshape(len(ids), -1), lists.reshape(-1, len(ids))
            asked = _matrix(queries.column("v"))
            bound = float(np.abs(vectors).max(initial=0)) * float(np.abs(asked).max(initial=0)) * max(1, vectors.shape[1])
            kind = np.float64 if bound < EXACT else object
            ordered = np.take_along_axis(vectors.T, lists.astype(np.int64), axis=1)
            vectors, asked, ordered = (x.astype(kind) for x in (vectors, asked, ordered))
            own = {(i, c): n for n, (i, c) in enumerate(zip(ids.tolist(), copies.tolist())) }
            for q, c, floor, v in zip(*(queries.column(x).to_pylist() for x in ("vec_id", "copy", "floor")), asked):
                best, read = threshold_topk(ids, vectors, v, k, lists, ordered, skip=own.get((q, c)), floor=floor)
                entries = vectors.size
                out += [(q, c, int(ids[i]), int(copies[i]), score, read if n == 0 else 0, entries if n == 0 else 0) for n, (score, i) in enumerate(best)]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(names, zip(*out) if out else [[]] * len(names))})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, query_copy, vec_id, copy, score, read, entries): each query's k best rows of every block.

    Both inputs have (vec_id, copy, v array<long>), not null; ``copy`` tells
    rows of one id apart.  A query is not its own candidate, and only vectors
    of the same length are compared.  Candidates are dealt into blocks and the
    sorted lists of each are made once, as a table.  The queries meet block 0
    first; the k-th scores found there are floors for the scans of all other
    blocks.  ``read``/``entries`` (on one row of a query and block) tell how
    many list entries a scan read, and how many there are.
    """
    many, asked = vectors.count(), queries.count()
    blocks, rounds = max(1, -(-many // CANDIDATES)), max(1, -(-asked // QUERIES))
    deal = F.xxhash64("vec_id", "copy")
    dealt = vectors.select(F.size("v").alias("dims"), F.pmod(deal, F.lit(blocks)).cast("int").alias("block"), "vec_id", "copy", "v")
    lists = materialise(dealt.groupBy("dims", "block").applyInArrow(_sorted_lists, LISTS), "lists")
    q = queries.select(F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id", "copy", F.lit(1)), F.lit(rounds)).cast("int").alias("round"), "vec_id", "copy", "v")
    key = ["dims", "block", "round"]

    def scan(q: DataFrame, first: int, last: int) -> DataFrame:
        q = q.withColumn("block", F.explode(F.sequence(F.lit(first), F.lit(last))))
        c = lists.where(F.col("block").between(first, last)).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
        return q.groupBy(*key).cogroup(c.groupBy(*key)).applyInArrow(_search(k), FOUND)

    found = scan(q.withColumn("floor", F.lit(None).cast("long")), 0, 0)
    if blocks == 1:
        return found
    found = materialise(found, "found")
    floors = found.groupBy("query_id", "query_copy").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    later = q.join(floors, (q["vec_id"] == floors["query_id"]) & (q["copy"] == floors["query_copy"]), "left").drop("query_id", "query_copy")
    return found.unionByName(scan(later, 1, blocks - 1))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates, ties to the smaller id (see ``search``).

    Scores have to fit into a long.  An empty table gives no rows."""
    order = Window.partitionBy("query_id", "query_copy").orderBy(F.col("score").desc(), "vec_id", "copy")
    found = search(vectors, queries, k).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(embeddings: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, copy, v): components as floor(scale * x) in long; null ids, null vectors, and vectors with a null or
    non-finite component are left out.  Every row stays; ``copy`` numbers the rows that repeat an id, by their vectors."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    rows = embeddings.where(F.coalesce(fine, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    # Equal rows are counted before the window, so an id repeated any number of times is one row for each of its vectors.
    times = rows.groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    before = Window.partitionBy("vec_id").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("times").over(before), F.lit(0))
    numbered = times.withColumn("first", first).select("vec_id", F.explode(F.sequence("first", F.col("first") + F.col("times") - 1)).alias("copy"), "v")
    return materialise(numbered, "vectors")


def search_rows(embeddings: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``top_k`` with the rows whose id is divisible by ``every`` as queries, against all rows."""
    vectors = scaled(embeddings, scale, id_col, vector_col)
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)
