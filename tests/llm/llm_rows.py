"""Small tables for the operators' tests."""

import random

WORDS = [a + b for a in ("ba", "ko", "ri", "tu", "sha", "él", "mo") for b in ("na", "le", "st", "or", "ñu", "ck", "dy", "x")]

#: Extra columns whose names the operators use inside.
CLASH = ["t", "h", "base", "found", "n", "g", "marks", "row", "label", "x", "component", "w", "v", "id", "key", "p", "part", "best", "features"]


def docs(spark, rows, extra=True):
    """A documents table from (doc_id, text) rows, with clashing extra columns."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.selectExpr("*", *(f"'{c}' AS {c}" for c in CLASH))
    return df


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def edited(rng: random.Random, text: str, times: int) -> str:
    words = text.split(" ")
    for _ in range(times):
        words[rng.randrange(len(words))] = "edit%d" % rng.randrange(10**6)
    return " ".join(words)
