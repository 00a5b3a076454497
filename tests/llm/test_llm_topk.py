import math
import random

import numpy as np
import pytest

from telespark.llm import topk


def brute(rows, every, k):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(fine):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(fine) if m != n and len(v) == len(w))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def rows(seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(5)]
    out = [(i, [float(np.float32(x + rng.gauss(0, 0.05))) for x in rng.choice(centres)]) for i in range(300)]
    out += [(300 + i, out[i][1]) for i in range(40)]  # ties
    out += [(400, [0.0] * 8), (410, None), (420, [1.0, None] + [0.0] * 6), (430, [float("nan")] * 8), (440, [float("inf")] + [0.0] * 7), (450, [0.5, -0.5]), (451, [0.25, 0.25]), (None, [0.1] * 8),
            (460, [-x for x in out[0][1]]), (20, out[20][1]), (20, out[21][1]), (30, out[30][1]), (30, out[30][1]), (7, out[8][1]), (470, []), (480, [1.0, 2.0, 3.0])]
    return out


@pytest.mark.parametrize("seed,candidates,queries", [(1, 4096, 1024), (2, 60, 7)])
def test_results_are_those_of_all_pairs(spark, monkeypatch, seed, candidates, queries):
    monkeypatch.setattr(topk, "CANDIDATES", candidates)
    monkeypatch.setattr(topk, "QUERIES", queries)
    data = rows(seed)
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS dims", "3 AS block", "4 AS score")
    got = sorted(map(tuple, topk.search_rows(df, every=10, k=10).collect()))
    assert got == brute(data, 10, 10)


def test_reading_stops_early():
    rng = np.random.default_rng(0)
    vectors = rng.normal(0, 100, (20_000, 3)).astype(np.int64).astype(float)
    lists = np.argsort(-vectors.T, axis=1, kind="stable")
    ordered = np.take_along_axis(vectors.T, lists, axis=1)
    touched = set()

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                touched.update(at.tolist())
            return np.asarray(self)[at]

    query = np.array([3.0, -2.0, 1.0])
    got, read = topk.threshold_topk(np.arange(20_000), vectors.view(Watched), query, 5, lists, ordered)
    score = vectors @ query
    want = np.lexsort((np.arange(20_000), -score))[:5]
    assert got == [(int(score[i]), int(i)) for i in want]
    assert len(touched) < 4000 and read < 12_000
    _, less = topk.threshold_topk(np.arange(20_000), vectors, query, 5, lists, ordered, floor=got[0][0] * 1.2)
    assert less < read


def test_clustered_blocks_are_read_in_part(spark, monkeypatch):
    """Scans of the registered kind: floors from block 0 stop the others early."""
    monkeypatch.setattr(topk, "CANDIDATES", 2000)
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (40, 6))
    data = [(i, [float(x) for x in centres[i % 40] + rng.normal(0, 0.02, 6)]) for i in range(8000)]
    vectors = topk.scaled(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    found = topk.search(vectors, vectors.where("vec_id % 100 = 0"), 10).agg({"read": "sum", "entries": "sum"}).first().asDict()
    assert found["sum(read)"] < 0.7 * found["sum(entries)"]


def test_every_row_is_a_candidate(spark):
    data = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [2.0, 0.0]), (100, [0.25, 0.0])]
    got = topk.search_rows(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, got.collect())) == brute(data, 100, 10)


def test_large_components_stay_exact(spark):
    data = [(0, [2.0**29, 1.0]), (1, [2.0**12, 1.0]), (2, [2.0**12, 1.25]), (3, [-(2.0**12), 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.search_rows(df, every=100, k=3).collect())) == brute(data, 100, 3)


def test_empty_table(spark):
    assert topk.search_rows(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
