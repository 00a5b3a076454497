"""Hard negatives by inner product: BOND vertical scans over blocks of columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Values (rows x dimensions) in a block of candidates, and anchors that meet it in one task.
BLOCK, ANCHORS = 1 << 18, 512
#: Dimensions that a scan reads before the bounds are looked at again.
STEP = 8
#: Products beyond this are not exact in doubles; Python's integers take their place.
EXACT = 2**53

ROW = ["id", "copy"]  # a row: its id, and its number among the rows that repeat the id


# ------------------------------------------------------------------ a block

class Columns:
    """Candidates of one block, a contiguous array for each dimension."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.copies, self.labels = ids, copies, labels
        self.exact = float(np.abs(vectors).max(initial=0)) ** 2 * max(1, vectors.shape[1]) < EXACT
        self.of = np.ascontiguousarray(vectors.T.astype(np.float64 if self.exact else object))
        self.low, self.high = (f(axis=1, initial=0) for f in (self.of.min, self.of.max)) if self.exact else (None, None)
        self.square = (self.of * self.of).sum(axis=0)
        self.read = self.entries = 0  # values read so far, and values that full products would read


class Best:
    """Keeps what may be among the k highest scores."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor = k, floor

    def keep(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if len(low) >= self.k:
            self.floor = max(self.floor, np.partition(low, -self.k)[-self.k])
        return high >= self.floor


class Windows:
    """Keeps what may be among the k highest scores inside one of the windows.

    A window is (low, high, floor): a score below the floor is known to be beaten by k others of the window."""

    def __init__(self, k: int, windows: list[list[float]]):
        self.k, self.windows = k, windows

    def keep(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        alive = np.zeros(len(low), bool)
        for w in self.windows:
            sure = low[(low >= w[0]) & (high <= w[1])]
            if len(sure) >= self.k:
                w[2] = max(w[2], np.partition(sure, -self.k)[-self.k])
            alive |= (high >= max(w[0], w[2])) & (low <= w[1])
        return alive


def vertical_scan(block: Columns, anchor: np.ndarray, among: np.ndarray, goal: Best | Windows) -> tuple[np.ndarray, np.ndarray]:
    """(candidates, scores) that the goal still keeps when all dimensions are read.

    Dimensions are read in the order of the anchor's falling magnitude.  What the unread ones can add lies between
    their smallest and largest values in the block, and within the lengths of both remainders; candidates whose
    bounds miss the goal leave the bitmap and are not read any further.  Scores are exact integers."""
    block.entries += len(among) * len(anchor)
    if not block.exact or float(np.abs(anchor).max(initial=0)) * float(np.abs(block.of).max(initial=0)) * max(1, len(anchor)) >= EXACT:
        block.read += len(among) * len(anchor)
        return among, sum((int(a) * block.of[d, among].astype(object) for d, a in enumerate(anchor)), np.zeros(len(among), object))
    order = np.argsort(-np.abs(anchor), kind="stable")
    weight = anchor[order].astype(np.float64)
    a, b = weight * block.low[order], weight * block.high[order]
    # What the dimensions from a place on can add, and the length of the rest of the anchor.
    least = np.append(np.cumsum(np.minimum(a, b)[::-1])[::-1], 0.0)
    most = np.append(np.cumsum(np.maximum(a, b)[::-1])[::-1], 0.0)
    length = np.append(np.cumsum((weight * weight)[::-1])[::-1], 0.0)
    score, square = np.zeros(len(among)), block.square[among]
    for at in range(0, len(order), STEP):
        dims = order[at : at + STEP]
        values = block.of[dims] if len(among) == block.of.shape[1] else block.of[np.ix_(dims, among)]
        block.read += values.size
        score = score + weight[at : at + STEP] @ values
        end = at + len(dims)
        if end == len(order):
            break
        square = square - np.einsum("ij,ij->j", values, values)
        reach = np.sqrt(length[end] * square) * (1 + 1e-9)  # rounding must not lose a candidate
        alive = goal.keep(score + np.maximum(-reach, least[end]), score + np.minimum(reach, most[end]))
        if not alive.all():
            among, score, square = among[alive], score[alive], square[alive]
            if not len(among):
                break
    return among, score


# ------------------------------------------------------------------ tasks

def _vectors(table: pa.Table) -> np.ndarray:
    flat = table.column("v").combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _block(table: pa.Table) -> Columns:
    return Columns(*(table.column(c).to_numpy() for c in (*ROW, "label")), _vectors(table))


def _anchors(table: pa.Table) -> Iterator[tuple[dict, np.ndarray]]:
    rest = table.drop_columns(["v"]).to_pylist()
    return zip(rest, _vectors(table) if rest else [])


def _top(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k] if score.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:k], int)


POSITIVES = "a_id long, a_copy long, a_label long, p_id long, p_copy long, score long"


def _positive_task(k: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and candidates.num_rows:
            block = _block(candidates)
            every = np.arange(len(block.ids))
            for a, v in _anchors(anchors):
                others = every[(block.ids != a["id"]) | (block.copies != a["copy"])]
                found, score = vertical_scan(block, v, others, Best(k, -np.inf if a["floor"] is None else a["floor"]))
                for i in _top(block.ids[found], score, k):
                    out.append((a["id"], a["copy"], a["label"], int(block.ids[found[i]]), int(block.copies[found[i]]), int(score[i])))
        return _rows(out, POSITIVES)

    return run


NEGATIVES = "a_id long, a_copy long, a_label long, p_id long, p_copy long, p_score long, n_id long, n_copy long, score long"


def _negative_task(k: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and candidates.num_rows:
            block = _block(candidates)
            every = np.arange(len(block.ids))
            for a, v in _anchors(anchors):
                windows = [[float(w["low"]), float(w["high"]), -np.inf if w["floor"] is None else float(w["floor"])] for w in a["windows"]]
                found, score = vertical_scan(block, v, every[block.labels != a["label"]], Windows(k, windows))
                for w in a["windows"]:
                    inside = np.flatnonzero((score >= w["low"]) & (score <= w["high"]))
                    for i in inside[_top(block.ids[found[inside]], score[inside], k)]:
                        n = found[i]
                        out.append((a["id"], a["copy"], a["label"], w["p_id"], w["p_copy"], w["p_score"], int(block.ids[n]), int(block.copies[n]), int(score[i])))
        return _rows(out, NEGATIVES)

    return run


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


# ------------------------------------------------------------------ the operator

def usable_rows(embeddings: DataFrame, label: Column, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, copy, label, v): components as floor(scale * x).  Rows with a null id, label or vector, or a null or
    non-finite component, take no part.  ``copy`` numbers the rows that repeat an id, by their values."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = embeddings.where(F.coalesce(fine, F.lit(False)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v")).where("label IS NOT NULL")
    # Equal rows are counted before the window, so an id repeated any number of times is one row for each of its values.
    times = rows.groupBy("id", "label", "v").agg(F.count("*").alias("times"))
    before = Window.partitionBy("id").orderBy("label", "v").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("times").over(before), F.lit(0))
    return times.withColumn("first", first).select("id", F.explode(F.sequence("first", F.col("first") + F.col("times") - 1)).alias("copy"), "label", "v")


def _dealt(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(anchors, candidates): the rows of each key in blocks, its anchors in turns; every block is there for each turn."""
    size = F.greatest(F.lit(1), F.floor(BLOCK / F.greatest(F.lit(1), F.col("dims"))))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("a").alias("na")).where("na > 0")
    sizes = sizes.select(*keys, F.ceil(F.col("n") / size).cast("int").alias("blocks"), F.ceil(F.col("na") / ANCHORS).cast("int").alias("turns"))
    sized, deal = rows.join(sizes, keys), F.xxhash64(*ROW)
    anchors = sized.where("a").withColumn("turn", F.pmod(deal, "turns").cast("int"))
    candidates = sized.withColumn("block", F.pmod(deal, "blocks").cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    return anchors, candidates


def _best(keys: list[str], anchors: Callable[[DataFrame | None], DataFrame], candidates: DataFrame, state: str, task, schema: str, own: list[str], found: list[str], k: int) -> DataFrame:
    """The k best rows (by score, then ``found``) of each ``own``, ranked, from scans of every block.

    Block 0 is scanned first.  The k-th scores found there are the floors with which the scans of the others begin:
    ``anchors`` gives the anchors with their ``state``, for the floors known so far."""
    keys = [*keys, "block", "turn"]
    columns = list(dict.fromkeys([*keys, *ROW, "label", "v"]))

    def scan(a: DataFrame, c: DataFrame) -> DataFrame:
        c = c.select(*(F.col(x).alias(x) for x in columns))  # both sides come from one table
        return a.select(*columns, state).groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(task, schema)

    first = materialise(scan(anchors(None).withColumn("block", F.lit(0)), candidates.where("block = 0")), "first")
    floors = first.groupBy(*own).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    later = anchors(floors).where("blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)))
    order = Window.partitionBy(*own).orderBy(F.col("score").desc(), *found)
    return first.unionByName(scan(later, candidates.where("block > 0"))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` as from ``usable_rows``.  An anchor's positives are its best other rows of the same label; for each
    positive, the best rows of other labels whose score is low% to high% of the positive's are its negatives.  Best:
    highest inner product, ties by smaller id.  Only vectors of one length are compared.  A negative positive score
    leaves an empty window, and a zero one takes zero scores.

    Candidates are dealt into blocks, for the positives inside a label, so that an anchor meets its own label alone.
    An empty table, no anchors, or no row of another label give no rows.  Scores have to fit into a long.
    """
    rows = materialise(rows.withColumns({"dims": F.size("v"), "a": F.coalesce(is_anchor, F.lit(False))}), "vectors")
    anchor = ["a_id", "a_copy"]

    def known(a: DataFrame, about: DataFrame, how: str) -> DataFrame:
        return a.join(about, [a["id"] == about["a_id"], a["copy"] == about["a_copy"]], how).drop(*anchor)

    some, candidates = _dealt(rows, ["dims", "label"])

    def with_floor(floors: DataFrame | None) -> DataFrame:
        return some.withColumn("floor", F.lit(None).cast("long")) if floors is None else known(some, floors, "left")

    best = _best(["dims", "label"], with_floor, candidates, "floor", _positive_task(positives), POSITIVES, anchor, ["p_id", "p_copy"], positives)

    def percent(p: int) -> Column:
        return F.col("score").cast("decimal(24,0)") * p / F.lit(100).cast("decimal(3,0)")

    windows = best.select(*anchor, "p_id", "p_copy", F.col("score").alias("p_score"), F.ceil(percent(low)).cast("long").alias("low"), F.floor(percent(high)).cast("long").alias("high"))
    windows = materialise(windows.where("low <= high"), "windows")
    own = [*anchor, "p_id", "p_copy"]
    asked, every = _dealt(rows, ["dims"])

    def with_windows(floors: DataFrame | None) -> DataFrame:
        w = windows.withColumn("floor", F.lit(None).cast("long")) if floors is None else windows.join(floors, own, "left")
        return known(asked, w.groupBy(*anchor).agg(F.collect_list(F.struct("p_id", "p_copy", "p_score", "low", "high", "floor")).alias("windows")), "inner")

    last = _best(["dims"], with_windows, every, "windows", _negative_task(negatives), NEGATIVES, own, ["n_id", "n_copy"], negatives)
    return last.select(F.col("a_id").alias("anchor_id"), F.col("p_id").alias("positive_id"), "rank", F.col("n_id").alias("negative_id"),
                       F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"))
