import hashlib
import random
from collections import defaultdict

import pytest
from llm_rows import CLASH, prose
from pyspark.sql import functions as F

from telespark.llm import mixing

SF_DIR = "/root/testdata/sf0.01"
TARGETS = {"source": {"a": 0.3, "b": 0.5, "gone": 0.2}, "lang": {"en": 0.6, "de": 0.4}}


def rows():
    rng = random.Random(1)
    out = [(i, prose(rng, rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["en", "en", "en", "de", "fr"])) for i in range(1500)]
    return out + [(2000, None, "a", "en"), (2001, "", "b", "de"), (2001, "", "b", "de"), (None, "x y", None, None), (2002, "w " * 20_000, "c", "fr")]


def brute(data, fraction, rounds=50):
    name = lambda m, v: v if v in TARGETS[m] else "other"
    tokens = [len((t or "").split()) + 1 for _, t, _, _ in data]
    cells = defaultdict(int)
    for (_, _, s, l), n in zip(data, tokens):
        cells[name("source", s), name("lang", l)] += n
    total = sum(cells.values())
    share = {c: n / total for c, n in cells.items()}
    want = []
    for k, m in enumerate(TARGETS):
        natural = defaultdict(float)
        for c, x in share.items():
            natural[c[k]] += x
        named = sum(TARGETS[m][v] for v in natural if v != "other")
        want.append({v: x if v == "other" else TARGETS[m][v] / named * (1 - natural.get("other", 0)) for v, x in natural.items()})
    w = dict(share)
    for _ in range(rounds):
        for k in range(2):
            total = defaultdict(float)
            for c, x in w.items():
                total[c[k]] += x
            w = {c: x * want[k][c[k]] / total[c[k]] for c, x in w.items()}
    fraction = min(fraction, 1 / max(w[c] / share[c] for c in w))
    out = []
    for (i, _, s, l), n in zip(data, tokens):
        c = name("source", s), name("lang", l)
        p = round(min(1.0, fraction * w[c] / share[c]), 9)
        u = int(hashlib.md5(f"1:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        out.append((i, *c, n, round(p, 7), u < p))
    return sorted(out, key=repr), w, want


@pytest.mark.parametrize("fraction", [0.3, 0.8])
def test_probabilities_and_sample(spark, fraction):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, lang string").selectExpr("*", *(f"1 AS {c}" for c in CLASH), "2 AS probability", "3 AS natural")
    margins = {m: (F.col(m), t) for m, t in TARGETS.items()}
    got = mixing.mix(df, margins, fraction).select("row.doc_id", "source", "lang", "n_tokens", F.round("probability", 7).alias("p"), "kept").collect()
    want, w, target = brute(rows(), fraction)
    assert sorted(map(tuple, got), key=repr) == want
    kept = mixing.sample(df, margins, fraction)
    assert kept.columns == df.columns and kept.count() == sum(r[-1] for r in want)
    for k in range(2):
        for v, t in target[k].items():
            assert abs(sum(x for c, x in w.items() if c[k] == v) - t) < 1e-9
    raked = mixing.rake(df, margins, mixing.n_tokens(), fraction)
    assert raked.error < 1e-12 and raked.fraction <= fraction


def test_sampled_shares_of_the_registered_targets(spark):
    from telespark.llm import queries

    got = queries.op6_mixing(spark, SF_DIR).cache()
    total = got.where("kept").agg(F.sum("n_tokens")).first()[0]
    assert got.agg(F.max("probability")).first()[0] <= 1.0
    for m, shares in (("source", queries.SOURCE_SHARES), ("lang", queries.LANG_SHARES), ("topic", queries.TOPIC_SHARES)):
        # Expected shares are the targets; the rows drawn differ from them by chance.
        want = {r[m]: r["w"] for r in got.groupBy(m).agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("w")).collect()}
        whole, known = sum(want.values()), sum(shares[v] for v in want if v in shares)
        assert total > 0 and all(abs(w / whole - shares[v] / known) < 1e-5 for v, w in want.items() if v != mixing.OTHER)


def test_targets_that_contradict_the_cells(spark):
    """Both margins cannot be met: the rounds end, the error says so, probabilities stay in [0, 1]."""
    df = spark.createDataFrame([(1, "x", "a", "en"), (2, "x", "b", "de")], "doc_id long, text string, source string, lang string")
    margins = {"source": (F.col("source"), {"a": 0.9, "b": 0.1}), "lang": (F.col("lang"), {"en": 0.2, "de": 0.8})}
    raked = mixing.rake(df, margins, mixing.n_tokens(), 0.5, rounds=4)
    assert raked.rounds == 4 and raked.error > 0.1
    assert all(0 <= r.probability <= 1 for r in mixing.mix(df, margins, 0.5).collect())


def test_zero_target(spark):
    df = spark.createDataFrame([(i, "x y", "ab"[i % 2]) for i in range(50)], "doc_id long, text string, source string")
    got = mixing.mix(df, {"source": (F.col("source"), {"a": 0.0, "b": 1.0})}, 1.0).collect()
    assert {(r.source, r.probability, r.kept) for r in got} == {("a", 0.0, False), ("b", 1.0, True)}


def test_empty_table_and_bounds(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert mixing.mix(df, {"lang": (F.col("lang"), {"en": 1.0})}).collect() == []
    with pytest.raises(ValueError):
        mixing.rake(df, {}, mixing.n_tokens(), 0.0)


def test_any_number_of_cells(spark):
    """Only the values that the targets name are bounded, not their combinations."""
    df = spark.createDataFrame([(i, "x", str(i % 90), str(i % 7), str(i % 11)) for i in range(300)], "doc_id long, text string, a string, b string, c string")
    raked = mixing.rake(df, {m: (F.col(m), {str(i): 1.0 for i in range(99)}) for m in "abc"}, mixing.n_tokens(), 0.5, rounds=2)
    assert {m: len(f) for m, f in raked.factors.items()} == {"a": 90, "b": 7, "c": 11} and 0 < raked.fraction <= 0.5
