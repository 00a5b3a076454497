"""Decision trees of Spark ML as plain data and as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_LINE = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$|^( *)Predict: (\S+)$")


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    threshold: float
    low: Leaf | Split
    high: Leaf | Split


def read_tree(text: str) -> Leaf | Split:
    """The tree that a fitted model's ``toDebugString`` describes."""
    lines = [m for m in map(_LINE.match, text.splitlines()) if m]

    def node(at: int) -> tuple[Leaf | Split, int]:
        m = lines[at]
        if m[6] is not None:
            return Leaf(float(m[6])), at + 1
        low, after = node(at + 1)
        high, after = node(after + 1)  # the line at `after` is the Else of this node
        return Split(int(m[2]), float(m[4]), low, high), after

    return node(0)[0]


def rules(tree: Leaf | Split) -> set[tuple[tuple[int, str, float], ...]]:
    """Every path from the root to another node, as a conjunction of conditions."""
    found = set()

    def walk(node: Leaf | Split, path: dict[tuple[int, str], float]) -> None:
        if path:
            found.add(tuple(sorted((f, op, v) for (f, op), v in path.items())))
        if isinstance(node, Split):
            for op, child, tighter in (("<=", node.low, min), (">", node.high, max)):
                key = (node.feature, op)
                walk(child, path | {key: tighter(path.get(key, node.threshold), node.threshold)})

    walk(tree, {})
    return found


def holds(rule: tuple[tuple[int, str, float], ...], features: list[Column]) -> Column:
    """1.0 where all conditions of the rule hold, else 0.0."""
    cond = F.lit(True)
    for f, op, v in rule:
        cond = cond & (features[f] <= v if op == "<=" else features[f] > v)
    return F.when(cond, 1.0).otherwise(0.0)


def value(tree: Leaf | Split, features: list[Column]) -> Column:
    """The tree's prediction as a nested CASE."""
    if isinstance(tree, Leaf):
        return F.lit(tree.value)
    return F.when(features[tree.feature] <= tree.threshold, value(tree.low, features)).otherwise(value(tree.high, features))
