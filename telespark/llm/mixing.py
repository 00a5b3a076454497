"""Mixing documents to target shares by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, whole_text, words

#: Values that the targets do not name.
OTHER = "other"


def n_tokens(text_col: str = "text") -> Column:
    """Tokens of a text: its words and one separator."""
    return F.size(words(whole_text(text_col))).cast("long") + 1


def topic(text_col: str = "text") -> Column:
    """A coarse content class: notice, contact, table or prose (the first that fits)."""
    t = whole_text(text_col)
    return (F.when(t.contains("icensed under") | t.contains("License.") | t.contains("rights reserved"), "notice")
            .when(t.contains("@") | t.contains(" +1 "), "contact").when(t.contains(" | "), "table").otherwise("prose"))


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _named(value: Column, targets: Mapping[str, float]) -> Column:
    value = value.cast("string")
    return F.when(value.isin(list(targets)), value).otherwise(OTHER)


@dataclass
class Raking:
    """Weights of the values of each margin, and how well they meet the targets.

    The weight of a cell is the product of its values' factors, so the table
    of cells is never needed again.  ``fraction``: share of all tokens that is
    kept; ``error``: largest difference of a raked share from its target.
    """

    factors: dict[str, dict[str, float]]
    fraction: float
    error: float
    rounds: int


def _wanted(natural: Mapping[str, float], targets: Mapping[str, float]) -> dict[str, float]:
    """Share of each value that occurs: `other` keeps its own, the present named ones split the rest."""
    left = 1.0 - natural.get(OTHER, 0.0)
    named = sum(float(targets[v]) for v in natural if v != OTHER)
    return {v: x if v == OTHER else float(targets[v]) * left / named if named else 0.0 for v, x in natural.items()}


def rake(docs: DataFrame, margins: Mapping[str, tuple[Column, Mapping[str, float]]], tokens: Column, fraction: float, rounds: int = 50, tolerance: float = 1e-14) -> Raking:
    """Fit the factors of every margin's values to its targets.

    The cells that occur are summed once.  Each step is one aggregate of them
    by one margin, whose sums (no more than the targets name) come back; rounds
    go on until no share is off by more than ``tolerance``, or to ``rounds``
    where the margins contradict each other (``error`` tells).  No cell may
    give more than all of its tokens: ``fraction`` falls to what the scarcest
    cell allows, so the targets are met and not only approached.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction is over 0 and at most 1")
    cols = {m: f"_m{k}" for k, m in enumerate(margins)}
    named = docs.select(*(_named(c, t).alias(cols[m]) for m, (c, t) in margins.items()), tokens.alias("_n"))
    cells = materialise(named.groupBy(*cols.values()).agg(F.sum("_n").cast("double").alias("_n")), "cells")
    natural = {m: {r[0]: r[1] for r in cells.groupBy(c).agg(F.sum("_n")).collect()} for m, c in cols.items()}
    total = sum(next(iter(natural.values()), {}).values())
    if not total:
        return Raking({m: {OTHER: 1.0} for m in margins}, fraction, 0.0, 0)
    wanted = {m: _wanted({v: n / total for v, n in natural[m].items()}, t) for m, (_, t) in margins.items()}
    factors = {m: dict.fromkeys(natural[m], 1.0) for m in margins}

    error, done = 1.0, 0
    while done < rounds and error > tolerance:
        error, done = 0.0, done + 1
        for m, c in cols.items():
            for value, s in cells.groupBy(c).agg(F.sum(F.col("_n") * _weight(factors, cols)) / total).collect():
                error = max(error, abs(s - wanted[m][value]))
                factors[m][value] *= wanted[m][value] / s if s > 0 else 0.0
    most = cells.agg(F.max(_weight(factors, cols))).first()[0]
    return Raking(factors, min(fraction, 1 / most) if most > 0 else fraction, error, done)


def _weight(factors: Mapping[str, Mapping[str, float]], cols: Mapping[str, str]) -> Column:
    """Product of the factors of a cell's values; the maps are literals of the targets' size."""
    w = F.lit(1.0)
    for m, c in cols.items():
        w = w * F.element_at(F.map_from_arrays(F.lit(list(factors[m])), F.lit(list(factors[m].values()))), F.col(c))
    return w


def mix(docs: DataFrame, margins: Mapping[str, tuple[Column, Mapping[str, float]]], fraction: float = 0.6, seed: int = 1,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, one column for each margin, n_tokens, probability, kept) for every row of docs; ``row``: its own columns.

    ``margins``: name -> (expression, target share of tokens for each value).
    A row is kept when the uniform number of its id is under its cell's
    probability, so the kept tokens have the targets' shares up to sampling
    noise and amount to ``fraction`` of all, or less where a scarce cell would
    have to give more than it has.  Values outside the targets keep their
    natural share; targets of absent values go to the others in proportion.  Nulls and unnamed values count as
    ``other``; an empty text has one token; repeated ids (and all null ids) are
    decided alike.  An empty table gives an empty result.
    """
    tokens = n_tokens(text_col)
    raked = rake(docs, margins, tokens, fraction)
    rows = docs.select(F.struct(*docs.columns).alias("row"), *(_named(c, t).alias(m) for m, (c, t) in margins.items()), tokens.alias("n_tokens"))
    p = F.lit(raked.fraction) * _weight(raked.factors, {m: m for m in margins})
    rows = rows.withColumn("probability", F.round(F.least(F.lit(1.0), p), 9))
    return rows.select("row", *margins, "n_tokens", "probability", (uniform(F.col(f"row.{id_col}"), seed) < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, margins: Mapping[str, tuple[Column, Mapping[str, float]]], fraction: float = 0.6, seed: int = 1,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of docs, with the columns of docs."""
    return mix(docs, margins, fraction, seed, id_col, text_col).where("kept").select("row.*")
