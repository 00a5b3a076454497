import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import WORDS

from telespark.llm import source_audit as sa

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = [t.translate(LOWER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        group = (lang or "", source or "")
        groups.add(group)
        n[group].update(terms)
        docs[group[0]].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, d in docs[lang].items() if d >= least]

        def prices(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        mine, every = prices(n[lang, source]), Counter()
        for g in groups:
            if g[0] == lang:
                every.update(n[g])
        pairs = [(-sum(abs(mine[t] - q) for t, q in prices(n[g]).items()), g[1]) for g in groups if g[0] == lang and g[1] != source]
        whole = prices(every)
        terms = [(whole[t] - mine[t], t) for t in kept if n[lang, source][t] and mine[t] > whole[t]]
        for part, items in (("pair", pairs), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:50])):
            out += [(lang, source, part, t, -v, r + 1) for r, (v, t) in enumerate(sorted(items, key=lambda x: (x[0], x[1].encode())))]
    return sorted(out)


def table(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        source = rng.choice(["a", "a", "a", "b", "c", "ß", None, ""])
        words = rng.choices(WORDS[: 20 if source == "b" else 40], [1 / (1 + i) for i in range(20 if source == "b" else 40)], k=rng.choice([0, 3, 30, 200]))
        rows.append((" ".join(w.upper() if rng.random() < 0.1 else w for w in words) + rng.choice(["", " x1y É_é\x7fz", "\x00q"]), rng.choice(["en", "en", None, "xx"]), source))
    rows += [(None, "en", "empty"), ("", "zz", "alone"), ("rare words", "yy", "one"), ("rare words", "yy", "two"), ("tu " * 50_000, "en", "long")]
    return rows + rows[:30]


def audited(spark, rows, least):
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS n", "3 AS block", "4 AS p", "5 AS item", "6 AS value")
    return sorted(map(tuple, sa.divergence(df.repartition(5), least).collect()))


@pytest.mark.parametrize("seed,sizes", [(1, {}), (2, {"TERMS": 7, "SOURCES": 2, "FULL": 3, "DENSE": 5, "HELD": 20})])
def test_values_are_those_of_every_term(spark, monkeypatch, seed, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(sa, name, value)
    rows = table(seed)
    got = audited(spark, rows, 30)
    assert got == brute(rows, 30) and {r[2] for r in got} == {"pair", "term"}


@pytest.mark.parametrize("full,dense", [(1, 512), (4, 3), (10**9, 512)])
def test_dense_and_sparse_products_agree(monkeypatch, full, dense):
    monkeypatch.setattr(sa, "FULL", full)
    monkeypatch.setattr(sa, "DENSE", dense)
    rng = np.random.default_rng(3)

    def side():
        cells = rng.random((50, 4)) < 0.6
        t, s = np.nonzero(cells)
        return sa.Levels(t, s, rng.integers(1, 5, len(t)), np.arange(len(t)))

    a, b = side(), side()
    want = np.zeros((len(a.size), len(b.size)), int)
    for t, c in zip(a.term, a.column):
        for u, d in zip(b.term, b.column):
            want[c, d] += t == u
    got = np.zeros_like(want)
    i, j, n = sa.joint_table(a, b, 50)
    np.add.at(got, (i, j), n)
    assert (got == want).all()


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(9_000_000_000_000, 12_345_678_901_234_567, 1000)], "n long, total long, terms long")
    assert df.select(sa._price(df["n"])).first()[0] == 1 + 10**9 * 9_000_000_000_005 // (12_345_678_901_234_567 + 5000)


def test_no_rows(spark):
    assert audited(spark, [], 30) == []


def test_a_task_hands_on_its_counts_in_small_batches(monkeypatch):
    """One Arrow batch of many terms: what is held is handed on inside the batch, in batches of few rows, and the sums stay."""
    monkeypatch.setattr(sa, "HELD", 100)
    texts = [f"common common {''.join(chr(97 + (i // 26**k) % 26) for k in range(3))} Common" for i in range(500)] + ["", "12"]
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en"] * 502, "source": [f"s{i % 2}" for i in range(502)]})
    monkeypatch.setattr(sa, "HANDED", 64, raising=False)
    out = list(sa._count(iter([batch])))
    assert max(b.num_rows for b in out) <= 64
    sums = {}
    for r in (r for b in out for r in b.to_pylist()):
        n, docs = sums.get((r["source"], r["term"]), (0, 0))
        sums[r["source"], r["term"]] = (n + r["n"], docs + r["docs"])
    assert sums["s0", "common"] == (750, 250) and sums["s1", "common"] == (750, 250)
    assert sums["s0", None] == (0, 0) and len(sums) == 2 + 2 + 500
