"""Removal of repeated word windows, with a count-min prefilter.

1. Each partition counts the windows of its texts in a count-min sketch;
   partition sketches are merged by adding.  A window is counted through its
   anchor, the smallest hash among its inner half-length shingles: equal
   windows have equal anchors, so an anchor's count is never under the
   window's own, and a text adds few of them.  Counters stop at two.
2. Texts without a window whose anchor is counted twice are finished.
   The others go to the exact pass with their estimated windows marked.
3. The exact pass deals marked texts into groups by a hash.  A group reduces
   its windows to (128-bit hash, smallest id); hashes that other groups hold
   with a smaller id come back as replies, so a window that a third of all
   texts share is one row per group.  With the replies, each group decides
   which words go.

The sketch has a fixed number of cells for the text bytes at hand, at most
``MAX_CELLS``; beyond that it overestimates more and the exact pass has more
to do, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, whole_text
from .hashing import Words, mix, multipliers, sliding, sliding_min, word_chunks

_U = np.uint64
#: Rows of the sketch, its pieces, and the most cells of a row (two bits each while merging, one bit in the broadcast).
DEPTH, SLICES, MAX_CELLS = 3, 64, 1 << 30
#: Partition sketches that one task merges.
FAN_IN = 64
#: Text bytes in a group of the exact pass.
GROUP_BYTES = 8 << 20


def _windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Position of each window's first word, and the document it is in."""
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    at = np.flatnonzero(doc[: max(0, len(doc) - size + 1)] == doc[size - 1 :])
    return at, doc[at]


def _anchors(w: Words, size: int, at: np.ndarray) -> np.ndarray:
    half = (size + 1) // 2
    return sliding_min(sliding(w.h1, half, 41), size - half + 1)[at]


def _cells(anchor: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The anchor's cell in each row of the sketch."""
    for row in range(DEPTH):
        yield (mix(anchor + multipliers(42, DEPTH)[row]) >> _U(64 - bits)).astype(np.uint32 if bits <= 32 else np.uint64)


def _sketch(size: int, bits: int):
    """Count anchors by text; a row for each sketch row and slice with cells seen once and more."""

    def run(batches):
        seen: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
        pending = 0

        def fold() -> None:
            for row in range(DEPTH):  # two of a cell are as good as many
                cells, n = np.unique(np.concatenate(seen[row]), return_counts=True)
                seen[row] = [np.repeat(cells, np.minimum(n, 2))]

        for batch in batches:
            for w in word_chunks(batch.column(0)):
                at, doc = _windows(w, size)
                if not len(at):
                    continue
                anchor = _anchors(w, size, at)
                new = np.ones(len(at), bool)  # a text counts an anchor once
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                doc, anchor = doc[new], anchor[new]
                order = np.lexsort((anchor, doc))
                doc, anchor = doc[order], anchor[order]
                new = np.ones(len(anchor), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                for row, cells in enumerate(_cells(anchor[new], bits)):
                    seen[row].append(cells)
                pending += int(new.sum())
                if pending > 1 << 22:
                    fold()
                    pending = 0
        rows = []
        for row in range(DEPTH):
            if not seen[row]:
                continue
            cells, n = np.unique(np.concatenate(seen[row]), return_counts=True)
            cut = np.searchsorted(cells, np.arange(SLICES + 1, dtype=np.uint64) << _U(bits - 6))
            for k in range(SLICES):
                part, many = cells[cut[k] : cut[k + 1]], n[cut[k] : cut[k + 1]] > 1
                if len(part):
                    rows.append((row, k, _pack(part, many, k, bits)))
        yield pa.RecordBatch.from_pydict({"row": pa.array([r[0] for r in rows], pa.int32()), "slice": pa.array([r[1] for r in rows], pa.int32()), "cells": pa.array([r[2] for r in rows], pa.binary())})

    return run, "row int, slice int, cells binary"


def _pack(cells: np.ndarray, many: np.ndarray, k: int, bits: int) -> bytes:
    """Cells of a slice: a list while they are few, else two bits for each cell."""
    width = 1 << (bits - 6)
    own = (cells.astype(np.int64) - k * width).astype(np.uint32)
    if len(own) * 4 < width // 4:
        return b"L" + (own << np.uint32(1) | many).tobytes()
    count = np.zeros(width, np.uint8)
    count[own] = 1 + many
    return b"B" + np.packbits(count > 0).tobytes() + np.packbits(count > 1).tobytes()


def _add(count: np.ndarray, packed: bytes) -> None:
    """Add a packed slice to the counters, stopping at two."""
    if packed[:1] == b"L":
        x = np.frombuffer(packed, np.uint32, offset=1)
        at = x >> np.uint32(1)
        count[at] = np.minimum(count[at] + 1 + (x & np.uint32(1)).astype(np.uint8), 2)
    else:
        some, many = np.unpackbits(np.frombuffer(packed, np.uint8, offset=1)).reshape(2, -1)
        np.minimum(count + some + many, 2, out=count)


def _merge(bits: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        count = np.zeros(1 << (bits - 6), np.uint8)
        for packed in table.column("cells"):
            _add(count, packed.as_py())
        row, k = table.column("row")[0].as_py(), table.column("slice")[0].as_py()
        if last:
            out = np.packbits(count > 1).tobytes()
        else:
            cells = np.flatnonzero(count)
            out = _pack(cells + k * len(count), count[cells] > 1, k, bits)
        return pa.table({"row": pa.array([row], pa.int32()), "slice": pa.array([k], pa.int32()), "cells": pa.array([out], pa.binary())})

    return run


def _repeated(source: DataFrame, size: int, bits: int) -> np.ndarray:
    """Bits of the cells counted twice or more: DEPTH x 2^bits / 8 bytes, a fixed size."""
    run, schema = _sketch(size, bits)
    sketch = source.select("text").mapInArrow(run, schema).withColumn("part", F.spark_partition_id())
    for _ in range(2):  # a tree, so that no task merges more than FAN_IN sketches of a slice at a time
        sketch = sketch.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        sketch = sketch.groupBy("row", "slice", "part").applyInArrow(_with_part(_merge(bits, False)), schema + ", part int")
    merged = sketch.groupBy("row", "slice").applyInArrow(_merge(bits, True), schema).collect()
    width = (1 << bits) // 8 // SLICES
    out = np.zeros((DEPTH, SLICES, width), np.uint8)
    for r in merged:
        out[r["row"], r["slice"]] = np.frombuffer(r["cells"], np.uint8)
    return out.reshape(DEPTH, -1)


def _with_part(merge):
    def run(table: pa.Table) -> pa.Table:
        return merge(table).append_column("part", table.column("part")[:1].combine_chunks())

    return run


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _split(size: int, bits: int, sketch):
    """Finish texts without an estimated repeat; mark the windows of the others."""
    schema = "doc_id long, n_words long, kept_sha256 string, text string, marks binary"

    def run(batches):
        bitmap = sketch.value
        for batch in batches:
            texts = batch.column(1)
            n, marks = [], []
            for w in word_chunks(texts):
                at, doc = _windows(w, size)
                hit = np.ones(len(at), bool)
                if len(at):
                    anchor = _anchors(w, size, at)
                    for row, cells in enumerate(_cells(anchor, bits)):
                        left = cells[hit]
                        hit[hit] = (bitmap[row, left >> 3] >> (7 - (left & 7)).astype(np.uint8)) & 1
                cut = np.searchsorted(doc, np.arange(len(w.first)))
                for i in range(len(w.first) - 1):
                    own = hit[cut[i] : cut[i + 1]]
                    n.append(int(w.first[i + 1] - w.first[i]))
                    marks.append(np.packbits(own).tobytes() if own.any() else None)
            open_ = np.array([m is not None for m in marks], bool)
            raw = texts.cast(pa.binary())
            done = [None if o else _digest((raw[i].as_py() or b"").split()) for i, o in enumerate(open_)]
            text = pa.array([raw[i].as_py() if o else None for i, o in enumerate(open_)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(done, pa.string()), text, pa.array(marks, pa.binary())], names=["doc_id", "n_words", "kept_sha256", "text", "marks"])

    return run, schema


def _marked(table: pa.Table, size: int):
    """Per chunk of a group's texts: words, index of its texts, marked windows and their 128-bit hashes."""
    texts = table.column("text").combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    marks = table.column("marks").to_pylist()
    for w in word_chunks(texts, two=True):
        at, doc = _windows(w, size)
        n = np.bincount(doc, minlength=len(w.first) - 1)
        own = [np.unpackbits(np.frombuffer(marks[w.docs + i], np.uint8), count=int(k)) for i, k in enumerate(n)]
        hit = np.concatenate(own).astype(bool) if own else np.zeros(0, bool)
        h1, h2 = sliding(w.h1, size, 43)[at[hit]], sliding(w.h2, size, 44)[at[hit]]
        yield w, at[hit], doc[hit], h1, h2


def _least(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray):
    """Distinct hashes with the smallest id of each."""
    order = np.lexsort((ids, h2, h1))
    h1, h2, ids = h1[order], h2[order], ids[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return h1[new], h2[new], ids[new]


def _ids(table: pa.Table) -> np.ndarray:
    """Ids as int64; a null id comes after all others, so it removes nothing."""
    return table.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()


def _summary(size: int):
    def run(table: pa.Table) -> pa.Table:
        ids, h1, h2, least = _ids(table), [], [], []
        for w, _, doc, a, b in _marked(table, size):
            x = _least(a, b, ids[w.docs + doc])
            for out, part in zip((h1, h2, least), x):
                out.append(part)
        none = np.zeros(0, _U)
        a, b, least = _least(np.concatenate(h1 or [none]), np.concatenate(h2 or [none]), np.concatenate(least or [none.astype(np.int64)]))
        return pa.table({"h1": a.view(np.int64), "h2": b.view(np.int64), "g": pa.array(np.full(len(a), table.column("g")[0].as_py(), np.int32)), "least": least})

    return run, "h1 long, h2 long, g int, least long"


def _decide(size: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": []}
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))})
        ids = _ids(table)
        chunks = list(_marked(table, size))
        known = [(a, b, ids[w.docs + doc]) for w, _, doc, a, b in chunks]
        known.append(tuple(replies.column(k).to_numpy().view(t) for k, t in (("h1", _U), ("h2", _U), ("least", np.int64))))
        h1, h2, least = _least(*(np.concatenate(x) for x in zip(*known)))
        for w, at, doc, a, b in chunks:
            lo, hi = np.searchsorted(h1, a, "left"), np.searchsorted(h1, a, "right")
            while (off := (h2[lo] != b) & (lo + 1 < hi)).any():  # 64-bit twins
                lo = lo + off
            gone = at[least[lo] < ids[w.docs + doc]]
            step = np.zeros(len(w.h1) + 1, np.int64)
            np.add.at(step, gone, 1)
            np.add.at(step, gone + size, -1)
            stays = np.cumsum(step[:-1]) == 0
            data = w.data.tobytes()
            for i in range(len(w.first) - 1):
                words = range(w.first[i], w.first[i + 1])
                kept = [data[w.start[k] : w.end[k]] for k in words if stays[k]]
                for name, v in zip(out, (table.column("doc_id")[w.docs + i].as_py(), len(words), len(words) - len(kept), _digest(kept))):
                    out[name].append(v)
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int64(), pa.int64(), pa.int64(), pa.string()))})

    return run, "doc_id long, n_words long, n_removed long, kept_sha256 string"


def substring_duplicates(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs.

    A word goes when a window of ``window`` words over it starts, with the
    same words, also in a document with a smaller id; windows are judged on
    the input.  ``kept_sha256`` is the digest of the kept words joined by one
    space.  Null, empty and blank texts have no words.  Texts shorter than the
    window lose nothing.  Rows that repeat an id do not remove each other's
    words.  A row without an id counts as larger than all others and removes
    nothing.  An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("string").alias("text"))
    nbytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About one anchor for 75 bytes of prose; 6 to 12 cells for each.
    bits = min(max(12, int(nbytes * 6 // 75).bit_length()), MAX_CELLS.bit_length() - 1)
    sketch = spark.sparkContext.broadcast(_repeated(source, window, bits))
    run, schema = _split(window, bits, sketch)
    split = materialise(source.mapInArrow(run, schema), "windows")
    done = split.where("text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    opened = split.where("text is not null").select("doc_id", "text", "marks")
    groups = max(shuffle_partitions(spark), (opened.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // GROUP_BYTES)
    opened = opened.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    run, schema = _summary(window)
    summary = opened.groupBy("g").applyInArrow(run, schema)
    first = F.min("least").over(Window.partitionBy("h1", "h2"))
    replies = summary.withColumn("first", first).where("first < least").select("g", "h1", "h2", F.col("first").alias("least"))
    run, schema = _decide(window)
    return done.unionByName(opened.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(run, schema))
