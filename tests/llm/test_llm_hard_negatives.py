import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from telespark.llm import hard_negatives as hn

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, every, positives=5, negatives=3, low=50, high=95):
    fine = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (a, lab, v) in enumerate(fine):
        if a % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), i, same == lab) for j, (i, same, w) in enumerate(fine) if j != k and len(v) == len(w)]
        for p, pid, _ in sorted(s for s in scores if s[2])[:positives]:
            inside = sorted((s, i) for s, i, same in scores if not same and low * -p <= 100 * -s <= high * -p)
            out += [(a, pid, n + 1, i, -p, -s) for n, (s, i) in enumerate(inside[:negatives])]
    return sorted(out)


def mined(df, every, **more):
    rows = hn.mine(hn.usable_rows(df, F.col("label")), F.col("id") % every == 0, **more)
    return sorted(map(tuple, rows.collect()))


def table(seed, n=260, dims=12):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(4)]
    out = [(i, [float(np.float32(x + rng.gauss(0, 0.15))) for x in centres[i % 4]], rng.choice([i % 4, i % 4, 3, 7])) for i in range(n)]
    out += [(500 + i, out[i][1], out[(i + 1) % 20][2]) for i in range(20)]  # ties
    out += [out[10], out[10], (20, out[3][1], 3), (20, out[20][1], 7)]  # ids and rows that repeat
    out += [(600, None, 1), (610, [1.0] * dims, None), (620, [None] + [0.5] * (dims - 1), 1), (630, [float("nan")] * dims, 1), (640, [float("inf")] * dims, 1), (None, [0.4] * dims, 1),
            (650, [0.0] * dims, 3), (660, [0.5, 0.25], 1), (661, [0.5, 0.5], 1), (662, [0.5, 0.2], 2), (670, [], 1), (671, [], 1), (672, [], 2), (680, [0.3] * dims, 99)]
    return out


@pytest.mark.parametrize("seed,block,anchors,step", [(1, 1 << 18, 512, 8), (2, 300, 5, 3)])
def test_results_are_those_of_all_pairs(spark, monkeypatch, seed, block, anchors, step):
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "ANCHORS", anchors)
    monkeypatch.setattr(hn, "STEP", step)
    rows = table(seed)
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS id", "2 AS copy", "3 AS block", "4 AS dims", "5 AS v", "6 AS a")
    got = mined(df, 10)
    assert got == brute(rows, 10) and len(got) > 50


def test_scan_reads_less_and_finds_all():
    rng = np.random.default_rng(0)
    vectors = np.floor(rng.normal(0, 30, (4000, 64))).astype(np.int64)
    block = hn.Columns(np.arange(4000), np.zeros(4000, int), np.zeros(4000, int), vectors)
    for q in vectors[:20]:
        found, score = hn.vertical_scan(block, q, np.arange(1, 4000), hn.Best(5, -np.inf))
        want = np.sort((vectors[1:] @ q))[::-1][:5]
        assert sorted(score, reverse=True)[:5] == want.tolist()
        low, high = want[4] * 0.5, want[4] * 0.95
        found, score = hn.vertical_scan(block, q, np.arange(1, 4000), hn.Windows(3, [[low, high, -np.inf]]))
        inside = np.sort(vectors[1:] @ q)[::-1]
        assert sorted(score[(score >= low) & (score <= high)], reverse=True)[:3] == inside[(inside >= low) & (inside <= high)][:3].tolist()
    assert block.read < 0.8 * block.entries


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**21, 1.0], 1), (1, [2.0**21, 1.25], 1), (2, [2.0**20, 1.0], 2), (3, [2.0**20, 1.25], 2), (5, [-(2.0**20), 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(df, 50) == brute(rows, 50) != []


def test_empty_tables(spark):
    assert mined(spark.createDataFrame([], KIND), 50) == []
    assert mined(spark.createDataFrame([(50, [1.0], 1)], KIND), 50) == []
    assert mined(spark.createDataFrame([(51, [1.0], 1), (52, [1.0], 2)], KIND), 50) == []
