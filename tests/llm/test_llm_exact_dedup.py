import hashlib
from collections import defaultdict

import pytest
from llm_rows import CLASH, docs
from pyspark.sql import functions as F

from telespark.llm import exact_dedup

ROWS = [(3, "A b"), (1, "a B"), (2, "a c"), (9, None), (8, ""), (7, "É"), (6, "é"), (5, "x" * 100_000), (4, "X" * 100_000), (2, "a c"), (None, "a C"), (None, "z")]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def weak(t):
    """A hash that many different texts share: their bytes tell them apart."""
    return (F.length(t) % 2).cast("string").cast("binary")


@pytest.mark.parametrize("keep,pick,digest", [("smallest", min, exact_dedup.content_hash), ("largest", max, exact_dedup.content_hash), ("largest", max, weak)])
def test_groups(spark, keep, pick, digest):
    got = exact_dedup.exact_duplicates(docs(spark, ROWS), keep, digest=digest).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[(t or "").translate(LOWER)].append(i)
    want = []
    for i, t in ROWS:
        t = (t or "").translate(LOWER)
        ids = [x for x in groups[t] if x is not None]
        best = pick(ids) if ids else None
        want.append((i, best, len(groups[t]), i == best, hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("keep,pick", [("smallest", min), ("largest", max)])
def test_one_row_of_each_text_stays(spark, keep, pick):
    table = docs(spark, ROWS)
    got = exact_dedup.deduplicate(table, keep)
    assert got.columns == table.columns and set(CLASH) <= set(got.columns)
    best = {}
    for i, t in ROWS:
        t = (t or "").translate(LOWER)
        if i is not None:
            best[t] = pick(i, best[t]) if best.get(t) is not None else i
        else:
            best.setdefault(t, None)
    assert sorted(map(repr, [(r.doc_id, (r.text or "").translate(LOWER)) for r in got.collect()])) == sorted(map(repr, [(i, t) for t, i in best.items()]))


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(docs(spark, [])).collect() == []
    assert exact_dedup.deduplicate(docs(spark, [])).collect() == []
