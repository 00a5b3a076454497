"""How far the sources of a language diverge in their use of terms: exact products of one-hot level matrices."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Distinct (language, source, term) that a task counts before it hands them on, in batches of so many rows; documents it unpacks at once.
HELD, HANDED, READ = 1 << 19, 1 << 14, 64
#: A term's documents are counted above this bit of its count of occurrences.
DOCS_AT = 40
ONE_DOC, OCCURRENCES = 1 << DOCS_AT, (1 << DOCS_AT) - 1
#: Terms of a language in a block of the matrices, and sources in a block of their columns.
TERMS, SOURCES = 2048, 64
#: A level column with at least so many terms of a block goes into the dense part of the product; the most columns there.
FULL, DENSE = 16, 512
#: Probabilities are whole parts of this, after adding SMOOTH to every count.
UNIT, SMOOTH = 1_000_000_000, 5

TERM = re.compile(rb"[a-z\x80-\xff]+")  # on UTF-8, where A-Z alone are lower-cased
COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's terms; a row without a term for each of its (language, source).

    A count is one number, documents above the occurrences; what is held is handed on in
    batches of HANDED rows, so a worker's memory does not follow the rows of an Arrow batch."""
    held: dict[tuple, dict[bytes, int]] = {}
    size = 0
    names, kinds = [c.split()[0] for c in COUNTS.split(", ")], [pa.string()] * 3 + [pa.int64()] * 2

    def rows() -> Iterator[tuple]:
        while held:
            group, terms = held.popitem()
            yield (*group, None, 0, 0)
            for term, n in terms.items():
                yield (*group, term.decode(), n & OCCURRENCES, n >> DOCS_AT)

    def flush() -> Iterator[pa.RecordBatch]:
        left = rows()
        while part := list(islice(left, HANDED)):
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names)

    for batch in batches:
        for start in range(0, batch.num_rows, READ):
            some = batch.slice(start, READ)
            for text, *group in zip(*(some.column(c).to_pylist() for c in ("text", "lang", "source"))):
                terms = held.setdefault(tuple(group), {})
                size -= len(terms)
                for term, n in Counter(TERM.findall(text.encode().lower())).items():
                    terms[term] = terms.get(term, 0) + ONE_DOC + n
                size += len(terms)
                if size > HELD:
                    yield from flush()
                    size = 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a row with a null term for every (lang, source)."""
    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return texts.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _price(n: Column) -> Column:
    """Parts of UNIT, exactly: 1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * terms))."""
    parts = (n + SMOOTH).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.when(F.col("total") + F.col("terms") > 0, F.call_function("div", parts, (F.col("total") + SMOOTH * F.col("terms")).cast("decimal(20,0)")) + 1).cast("long")


# ------------------------------------------------------------------ products

class Levels:
    """One block of columns: for each term and source with occurrences, the column (source, count) that has its one."""

    def __init__(self, term: np.ndarray, source: np.ndarray, n: np.ndarray, price: np.ndarray):
        key, first, self.column, size = np.unique(np.stack([source, n]), axis=1, return_index=True, return_inverse=True, return_counts=True)
        self.column = self.column.reshape(-1)
        self.term, self.source, self.price, self.size = term, key[0], price[first], size
        wide = np.argsort(-size, kind="stable")[:DENSE]
        self.dense = wide[size[wide] >= FULL]
        place = np.full(len(size), -1)
        place[self.dense] = np.arange(len(self.dense))
        self.place = place[self.column]

    def matrix(self, terms: int) -> np.ndarray:
        """The dense columns as a one-hot matrix: terms x columns."""
        out = np.zeros((terms, len(self.dense)), np.float32)
        at = self.place >= 0
        out[self.term[at], self.place[at]] = 1
        return out


def joint_table(a: Levels, b: Levels, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column of a, column of b, terms): the entries of the product of a's transpose with b that are not zero.

    Columns with many ones are multiplied as dense matrices (sums of ones below 2^24 are exact in single precision);
    what has a sparse column on either side is multiplied in coordinates, a one of a with the ones of b in its row."""
    product = a.matrix(terms).T @ b.matrix(terms)
    i, j = np.nonzero(product)
    parts = [(a.dense[i], b.dense[j], product[i, j].astype(np.int64))]
    order = np.argsort(b.term, kind="stable")
    first = np.searchsorted(b.term[order], np.arange(terms + 1))
    width = (first[1:] - first[:-1])[a.term]
    left = np.repeat(np.arange(len(a.term)), width)
    right = order[np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first[:-1][a.term], width)]
    sparse = (a.place[left] < 0) | (b.place[right] < 0)
    code, n = np.unique(a.column[left[sparse]] * len(b.size) + b.column[right[sparse]], return_counts=True)
    parts.append((code // max(1, len(b.size)), code % max(1, len(b.size)), n))
    return tuple(np.concatenate(x) for x in zip(*parts))


PAIRS = "lang string, source string, item string, value long"


def _price_blocks(table: pa.Table) -> pa.Table:
    """Of one block of terms and two of sources: for each pair of sources, the sum over the terms of |p - q|, less
    |p - q| of two sources without the term.  Rows without a term say which sources there are."""
    cols = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("right", "source", "term", "n", "p", "zero")}
    out: dict[str, list] = {c: [] for c in ("lang", "source", "item", "value")}
    names, source = np.unique(cols["source"].astype(str), return_inverse=True)
    zero = np.zeros(len(names), np.int64)
    zero[source] = cols["zero"]
    real = np.array([t is not None for t in cols["term"]], bool)
    kinds, term = np.unique(cols["term"][real].astype(str), return_inverse=True)
    sides, members = [], []
    same = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
    for right in ((False,) if same else (False, True)):
        side = cols["right"] == right
        members.append(np.unique(source[side]))
        sides.append(Levels(term[side[real]], source[real & side], cols["n"][real & side], cols["p"][real & side]))
    a, b = sides[0], sides[-1]
    i, j, n = joint_table(a, b, len(kinds))
    size = len(names)
    value = np.zeros((size, size), np.int64)
    g, h = a.source[i], b.source[j]
    np.add.at(value, (g, h), n * np.abs(a.price[i] - b.price[j]))
    both = np.zeros((size, size), np.int64)  # terms that both have
    np.add.at(both, (g, h), n)

    def alone(x: Levels, x_col: np.ndarray, others: np.ndarray, y_source: np.ndarray) -> np.ndarray:
        """Level 0 of the other side: the ones of a column that meet none of the source's, priced against no occurrence."""
        met = np.zeros((len(x.size), size), np.int64)
        np.add.at(met, (x_col, y_source), n)
        left = (x.size[:, None] - met[:, others]) * np.abs(x.price[:, None] - zero[others][None, :])
        sums = np.zeros((size, len(others)), np.int64)
        np.add.at(sums, x.source, left)
        return sums

    value[:, members[-1]] += alone(a, i, members[-1], h)
    value[members[0], :] += alone(b, j, members[0], g).T
    has_a, has_b = np.zeros(size, np.int64), np.zeros(size, np.int64)
    np.add.at(has_a, a.source, a.size)
    np.add.at(has_b, b.source, b.size)
    value -= (has_a[:, None] + has_b[None, :] - both) * np.abs(zero[:, None] - zero[None, :])
    lang = table.column("lang")[0].as_py()
    for x in members[0]:
        for y in members[-1]:
            if x != y:
                for s, t in ((x, y),) if same else ((x, y), (y, x)):
                    for c, v in zip(out, (lang, names[s], names[t], int(value[x, y]))):
                        out[c].append(v)
    return pa.table({c: pa.array(v, pa.int64() if c == "value" else pa.string()) for c, v in out.items()})


# ------------------------------------------------------------------ the operator

def divergence(docs: DataFrame, least_docs: int = 30, terms: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of docs.

    A language keeps the terms that at least ``least_docs`` of its documents have.  A term's price in a source, or in
    the whole language, is its smoothed share in whole parts of UNIT.  Part ``pair``: for each other source of the
    language the summed distance of all prices.  Part ``term``: the ``terms`` terms of the source whose price is most
    above the language's.  Ranks run by falling value, then by item in UTF-8 order.

    The distances come from joint tables of count levels: a (term x (source, count)) matrix of ones, multiplied by its
    transpose in blocks of terms and of sources, says how many terms have each pair of counts in two sources; a pair
    of levels is priced once.  Absent terms are level 0, priced from what the products leave over.

    Null text, lang and source count as ''.  Every row is a document, also one that repeats an id or a whole row.
    Terms of one task are counted before the shuffle, so a frequent term or a large source is a row per task.  A
    source without terms has pairs (against no occurrences) and no terms; a language with one source has no pairs.
    An empty table gives no rows.  Other columns are not read.
    """
    counts = materialise(term_counts(docs), "counts")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least_docs)
    kept = materialise(kept.select("lang", "term", "all"), "kept")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("total_lang"))
    cells = materialise(counts.where("term IS NOT NULL").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all"), "cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total_lang", F.lit(0)).alias("total_lang"))
    sources = Window.partitionBy("lang")
    groups = groups.withColumns({"zero": F.coalesce(_price(F.lit(0).cast("long")), F.lit(0).cast("long")), "n_sources": F.count("*").over(sources)})
    groups = materialise(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.ceil(F.col("n_sources") / SOURCES)).cast("int")), "groups")
    priced = materialise(cells.join(groups, ["lang", "source"]).withColumn("p", _price(F.col("n"))), "priced")

    # Terms that a source has more of than its language.
    whole = F.struct(F.col("total_lang").alias("total"), "terms")
    above = priced.withColumn("total", whole["total"]).withColumn("q", _price(F.col("all"))).where("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    top = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    top = top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms)

    # Blocks of terms and of sources; every two blocks of sources of a language meet in each block of its terms.
    columns = ["lang", "slice", "block", "blocks", "source", "term", "n", "p", "zero"]
    slices, blocks = F.ceil(F.col("terms") / TERMS).cast("int"), F.ceil(F.col("n_sources") / SOURCES).cast("int")
    ones = priced.withColumns({"slice": F.pmod(F.xxhash64("term"), slices).cast("int"), "blocks": blocks}).select(*columns)
    there = groups.where("terms > 0").withColumns({"slice": F.explode(F.sequence(F.lit(0), slices - 1)), "blocks": blocks, "term": F.lit(None).cast("string"),
                                                  "n": F.lit(0).cast("long"), "p": F.lit(0).cast("long")}).select(*columns)
    met = ones.unionByName(there).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other"), "right": F.col("block") > F.col("other")})
    partial = met.select("lang", "slice", "lo", "hi", "right", "source", "term", "n", "p", "zero").groupBy("lang", "slice", "lo", "hi").applyInArrow(_price_blocks, PAIRS)
    sums = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_item"))
    pairs = groups.select("lang", "source", "zero", F.col("terms").cast("long").alias("terms")).join(others, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
    value = F.coalesce("value", F.lit(0)) + F.col("terms") * F.abs(F.col("zero") - F.col("zero_item"))
    pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(order))
    return pair.unionByName(top)
