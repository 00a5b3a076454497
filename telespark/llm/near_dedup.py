"""MinHash near-duplicate groups with sequential Bayesian verification.

1. Every text becomes the set of its word shingles and a MinHash signature;
   texts with equal sets are collapsed to the smallest id first.
2. Signatures are cut into bands; sets that agree on a band are candidates.
   A bucket of any size gives one row per member: its link to the bucket's
   smallest member (a star), never all pairs.
3. Star pairs are verified: signatures are compared batch by batch, a pair is
   dropped as soon as the posterior probability that its similarity reaches
   the threshold falls under ``miss``, survivors are checked on full sets.
4. Buckets whose members then lie in one component need nothing more.  In the
   others, members of different components may still be linked: they are
   compared in blocks of bounded size (``BLOCK``), again signatures first and
   then full sets.  A component's own members are never compared again.
5. Components of all verified links.

The chance to lose a link of exactly the threshold is at most ``BAND_MISS``
in step 2 plus ``miss`` in steps 3 and 4; every reported link is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .graph import components
from .hashing import mix, multipliers, sliding, word_chunks

_U = np.uint64
#: Signature length, and the chance to miss a pair at the threshold by banding.
WIDTH, BAND_MISS = 336, 1e-7
#: Signature entries that one step of the sequential test adds.
BATCH = 48
#: Members in a block of the residual comparison; a task holds two blocks.
BLOCK = 128


class Settings:
    """Shingle size and similarity (percent) with the numbers that follow from them."""

    def __init__(self, shingle: int, percent: int, miss: float):
        self.shingle, self.percent = shingle, percent
        t = percent / 100
        self.rows = max([r for r in range(1, 13) if (1 - t**r) ** (WIDTH // r) <= BAND_MISS], default=1)
        self.bands = WIDTH // self.rows
        # The smallest set that can be similar to another set.
        self.smallest = next(n for n in range(1, 10**6) if 100 * n >= percent * (n + 1)) if percent < 100 else 1
        # A pair with fewer agreements after so many entries is dropped: its
        # posterior (uniform prior) of reaching t is P(Bin(n + 1, t) <= agreements).
        self.least = []
        for n in range(BATCH, WIDTH + 1, BATCH):
            tail, m = 0.0, -1
            while m < n and tail + math.comb(n + 1, m + 1) * t ** (m + 1) * (1 - t) ** (n - m) < miss:
                m += 1
                tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            self.least.append(m + 1)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, ASCII case folded."""
    for w in word_chunks(texts, lower=True):
        long = sliding(w.h1, size, 21)
        for i in range(len(w.first) - 1):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= size:
                yield np.unique(long[a : b - size + 1])
            elif b > a:  # too few words: the whole sequence is the one shingle
                yield mix(np.sum(w.h1[a:b] * multipliers(22, size)[: b - a], keepdims=True) + _U(b - a))
            else:
                yield np.zeros(0, _U)


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash signature of a non-empty set: minima of WIDTH linear maps."""
    x = (found >> _U(32)).astype(np.uint32)
    a, b = multipliers(31, WIDTH)[:WIDTH].astype(np.uint32) | np.uint32(1), (multipliers(32, WIDTH)[:WIDTH] >> _U(32)).astype(np.uint32)
    least = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(least, (x[k : k + 512, None] * a + b).min(axis=0), out=least)
    return least


def band_keys(sig: np.ndarray, s: Settings) -> np.ndarray:
    """One 64-bit key for each band (last axis: signature), the band's number included."""
    part = sig[..., : s.bands * s.rows].reshape(*sig.shape[:-1], s.bands, s.rows).astype(_U)
    mixed = mix(part + _U(0x9E3779B97F4A7C15)) * multipliers(33, s.rows)[: s.rows]
    return mix(mixed.sum(axis=-1, dtype=_U) + multipliers(34, s.bands)[: s.bands])


def _sketches(s: Settings):
    schema = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"

    def run(batches):
        for batch in batches:
            n, d, bands = [], [], []
            for found in shingle_sets(batch.column(1), s.shingle):
                n.append(len(found))
                d.append((mix(found * _U(3)).sum(dtype=_U), mix(found * _U(5) + _U(1)).sum(dtype=_U)))
                bands.append(band_keys(signature(found), s).view(np.int64) if len(found) >= s.smallest else None)
            digest = np.array(d, _U).reshape(-1, 2).view(np.int64)
            size = np.array([0 if x is None else len(x) for x in bands], np.int32)
            flat = np.concatenate([x for x in bands if x is not None] or [np.zeros(0, np.int64)])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), lists], names=["doc_id", "n_shingles", "d1", "d2", "bands"])

    return run, schema


def _sets(s: Settings):
    schema = "id long, sig binary, found binary"

    def run(batches):
        for batch in batches:
            sig, sets = [], []
            for found in shingle_sets(batch.column(1), s.shingle):
                sig.append(signature(found).tobytes())
                sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig, pa.binary()), pa.array(sets, pa.binary())], names=["id", "sig", "found"])

    return run, schema


def probable(a: np.ndarray, b: np.ndarray, s: Settings) -> np.ndarray:
    """Rows of two signature matrices that pass every step of the sequential test."""
    alive, agree = np.arange(len(a)), np.zeros(len(a), np.int32)
    for step, least in enumerate(s.least):
        cut = slice(step * BATCH, (step + 1) * BATCH)
        agree = agree + (a[alive, cut] == b[alive, cut]).sum(axis=1, dtype=np.int32)
        keep = agree >= least
        alive, agree = alive[keep], agree[keep]
    return alive


def _matrix(signatures: pa.BinaryArray) -> np.ndarray:
    """Signatures as rows of a matrix, without a copy."""
    _, offsets, data = signatures.buffers()
    start = np.frombuffer(offsets, np.int32)[signatures.offset]
    return np.frombuffer(data, np.uint32, len(signatures) * WIDTH, int(start)).reshape(-1, WIDTH)


def _pruned(s: Settings):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (_matrix(batch.column(k)) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).take(pa.array(probable(one, two, s)))

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x and y| >= percent * |x or y| for sorted sets; empty sets never."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not len(x):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(s: Settings):
    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            yes = [similar(np.frombuffer(x[i].as_buffer(), _U), np.frombuffer(y[i].as_buffer(), _U), s.percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return run


def _rest(s: Settings):
    """Links between members of different components, in two blocks of a cluster."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp, side = (table.column(k).to_numpy().copy() for k in ("id", "component", "side"))
        order = np.lexsort((ids, side))
        ids, comp, side = ids[order], comp[order], side[order]
        sets = table.column("found").to_pylist()
        sets = [np.frombuffer(sets[i], _U) for i in order]
        sigs = table.column("sig").to_pylist()
        sigs = np.stack([np.frombuffer(sigs[i], np.uint32) for i in order])
        keys = band_keys(sigs, s)
        sizes = np.array([len(x) for x in sets])
        words, place = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.append(0, np.cumsum(sizes))
        both_sides, links = len(set(side.tolist())) > 1, []
        for y in range(1, len(ids)):
            near = np.flatnonzero((keys[:y] == keys[y]).any(axis=1))
            if both_sides:
                near = near[side[near] != side[y]]
            near = near[comp[near] != comp[y]]
            while len(near):
                part, near = near[:64], near[64:]
                part = part[probable(sigs[part], np.broadcast_to(sigs[y], (len(part), WIDTH)), s)]
                if not len(part):
                    continue
                mark = np.zeros(len(words), bool)
                mark[place[at[y] : at[y + 1]]] = True
                both = np.array([int(mark[place[at[x] : at[x + 1]]].sum()) for x in part])
                for x in part[100 * both >= s.percent * (sizes[part] + sizes[y] - both)]:
                    if comp[x] != comp[y]:
                        links.append((ids[x], ids[y]))
                        comp[comp == comp[x]] = comp[y]
                near = near[comp[near] != comp[y]]
        out = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": out[:, 0].copy(), "b": out[:, 1].copy()})

    return run


def _residual(m: DataFrame, members: DataFrame, links: DataFrame, s: Settings) -> DataFrame:
    """Links that the stars did not try: between components that share a bucket."""
    label = materialise(components(links).select(F.col("node").alias("id"), "component"), "label")
    named = m.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    named = materialise(named.join(open_keys, "key", "left_semi"), "open")
    cluster = components(named.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")))
    rows = named.select("id", "component").distinct().join(cluster.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id")
    rows = materialise(rows, "rows")
    # Blocks: a large component has blocks of its own, the small ones share blocks (own: null).
    sizes = rows.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") >= BLOCK).select("cluster", F.col("component").alias("own"), F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    small = sizes.where(F.col("n") < BLOCK).groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"))
    name = F.concat_ws("/", F.col("own").cast("string"), F.col("part").cast("string"))
    block = large.unionByName(small, allowMissingColumns=True)
    block = materialise(block.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cluster", "own", name.alias("block")), "block")
    # Tasks: two blocks of a cluster, or one shared block with itself; never two of one component.
    x, y = (block.select("cluster", F.col("own").alias(f"own_{k}"), F.col("block").alias(k)) for k in "xy")
    tasks = x.join(y, "cluster").where("x <= y AND ((own_x IS NULL AND own_y IS NULL) OR NOT own_x <=> own_y)")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("block")), F.when(F.col("x") < F.col("y"), F.struct(F.lit(1).alias("side"), F.col("y").alias("block"))))
    sides = tasks.select("cluster", F.concat_ws("|", "x", "y").alias("task"), F.explode(F.array_compact(sides)).alias("at")).select("cluster", "task", "at.*")
    placed = (rows.join(large.withColumnRenamed("own", "component"), ["cluster", "component"], "left")
              .join(small.withColumnRenamed("parts", "shared"), "cluster", "left")
              .withColumn("own", F.when(F.col("parts").isNotNull(), F.col("component")))
              .withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", "shared")))
              .select("cluster", name.alias("block"), "id", "component"))
    dealt = placed.join(sides, ["cluster", "block"]).join(members, "id").select("cluster", "task", "side", "id", "component", "sig", "found")
    return dealt.groupBy("cluster", "task").applyInArrow(_rest(s), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = 1e-9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Two documents are linked when ``100 * |A and B| >= percent * |A or B|`` for
    their sets of ``shingle``-word shingles (A-Z folded).  ``component_id`` is
    the smallest id reachable over links, ``kept`` tells whether it is the
    row's own.  Fewer words than ``shingle``: the whole sequence is the one
    shingle.  Null, empty and blank texts: empty set, linked with nothing.
    Rows that repeat an id are one document: each of them has its own
    n_shingles and the component that the links of all of them reach.  Rows without an id have links
    with nothing: component null, kept.  An empty table gives an empty result.
    Other columns are not read.
    """
    s = Settings(shingle, percent, miss)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    run, schema = _sketches(s)
    found = materialise(source.mapInArrow(run, schema), "sketch")
    known = found.where("doc_id is not null")
    # Equal sets: one representative, the smallest id.
    equal = known.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "bands")).alias("m"))
    equal = materialise(equal.select("d1", "d2", "n_shingles", "m.*"), "equal")
    copies = known.join(equal.select("d1", "d2", "n_shingles", F.col("doc_id").alias("b")), ["d1", "d2", "n_shingles"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    band = equal.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    shared = band.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot <> last").select("key", "pivot")
    m = materialise(band.join(shared, "key").select("key", "pivot", "id"), "buckets")
    wanted = m.select("id").distinct()
    run, schema = _sets(s)
    texts = source.withColumnRenamed("doc_id", "id").join(wanted, "id", "left_semi")
    members = materialise(texts.mapInArrow(run, schema), "members")
    pairs = m.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()

    def with_both(p: DataFrame, col: str) -> DataFrame:
        one, two = (members.select(F.col("id").alias(k), F.col(col).alias(f"{col}_{k}")) for k in "ab")
        return p.join(one, "a").join(two, "b").select("a", "b", f"{col}_a", f"{col}_b")

    alive = materialise(with_both(pairs, "sig").mapInArrow(_pruned(s), "a long, b long").distinct(), "alive")
    links = materialise(with_both(alive, "found").mapInArrow(_verified(s), "a long, b long"), "links")
    rest = materialise(_residual(m, members, links, s), "rest")
    label = components(links.unionByName(rest).unionByName(copies)).select(F.col("node").alias("doc_id"), "component")
    out = found.select("doc_id", "n_shingles").join(label, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = 1e-9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its group, with the columns of docs.

    Rows without an id stay; rows that repeat a kept id stay together.
    """
    groups = near_duplicates(docs, shingle, percent, miss, id_col, text_col)
    dropped = groups.where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(dropped, id_col, "left_anti").select(*docs.columns)
