import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import docs, edited, prose

from telespark.llm import near_dedup
from telespark.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "").translate(LOWER)).split(" ") if x]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, percent):
    """All pairs, then a union-find over ids."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in combinations([s for s in sets if s[0] is not None], 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            i, j = find(i), find(j)
            up[max(i, j)] = min(i, j)
    return sorted([(i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets], key=repr)


def sample(seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(12):  # groups of near copies, chains among them
        text = prose(rng, rng.choice([8, 30, 120, 400]))
        for _ in range(rng.choice([1, 2, 5, 14])):
            rows.append((n, text))
            n += 1
            text = edited(rng, text, rng.choice([0, 1, 1, 2, 5]))
    base = prose(rng, 100)  # a star of copies around one text
    for _ in range(30):
        rows.append((n, edited(rng, base, rng.choice([1, 2, 3]))))
        n += 1
    rng.shuffle(rows)
    rows = [(rng.randrange(1000) * 1000 + k, t) for k, (_, t) in enumerate(rows)]
    i, t = rows[0]
    return rows + [(i, t), (10**7, None), (10**7 + 1, ""), (10**7 + 2, " \n\t "), (10**7 + 3, "One"), (10**7 + 4, "one"), (10**7 + 5, "one two"),
                   (10**7 + 6, "ONE\x0bTWO"), (None, t), (10**7 + 7, prose(rng, 30_000)), (10**7 + 8, "É a b c d e f g h"), (10**7 + 9, "é a b c d e f g h")]


@pytest.mark.parametrize("seed,size,percent,block", [(1, 3, 85, 128), (2, 5, 80, 3)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, size, percent, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = sample(seed)
    got = near_dedup.near_duplicates(docs(spark, rows), size, percent).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, size, percent)


def test_deduplicate_keeps_the_smallest_of_each_group(spark):
    rows = sample(3)
    table = docs(spark, rows)
    got = near_dedup.deduplicate(table, 3, 85)
    assert got.columns == table.columns
    assert sorted([r.doc_id for r in got.collect()], key=repr) == sorted([i for i, _, _, kept in brute(rows, 3, 85) if kept], key=repr)


def test_empty_table(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).collect() == []


def test_sequential_test_keeps_what_is_similar():
    s = near_dedup.Settings(3, 85, 1e-9)
    assert s.least == sorted(s.least) and len(s.least) == near_dedup.WIDTH // near_dedup.BATCH
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**32, (2000, near_dedup.WIDTH)).astype(np.uint32)
    for share, all_stay in ((0.87, True), (0.5, False)):
        b = np.where(rng.random(a.shape) < share, a, a + np.uint32(1))
        stay = len(near_dedup.probable(a, b, s))
        assert stay == 2000 if all_stay else stay == 0


def test_signatures_estimate_similarity():
    rng = random.Random(5)
    a = prose(rng, 400)
    b = edited(rng, a, 10)
    x, y = near_dedup.shingle_sets(pa.array([a, b]), 3)
    exact = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((near_dedup.signature(x) == near_dedup.signature(y)).mean() - exact) < 0.08


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3), (200, 150), (200, 160), (170, 160)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 150, 150: 150, 160: 150, 170: 150}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
