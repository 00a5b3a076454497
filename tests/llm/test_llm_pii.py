import hashlib
import random
import re

import pytest
from llm_rows import docs
from pyspark.sql import functions as F

from telespark.llm import pii

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def fine(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    spans = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        spans += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if fine(kind, m[0])]
    spans = [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)]
    return (*(sum(s.startswith(k + ":") for s in spans) for k in KINDS), hashlib.sha256(",".join(spans).encode()).hexdigest(), spans)


PIECES = ["a.b+c@mail5.example.com", "x@y", "@", "a@b.c_d@e.f.g", ".", "-", " ", " ", "\n", "é", "𝄞", "10.0.0.1", "256.1.1.1", "0000255.1.02.3", "1.2.3.4.5.6.7.8", "1..2",
          "4397110767823743", "4397 1107-6782 3743", "4397110767823744", "+1 (654) 555-4136", "+1 654", "+", "(", ")", "12", "7", "00", "word", "ABC", "%", "79927398713", "+123456789012345678"]


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


LONG = ["9" * 60_000, "a" * 200_000, "a" * 1000 + "@x" + ".y" * 20_000, "7 " * 30_000, "10.0.0.1 é " * 3000, "1" + "-1" * 30_000 + " a@b.c", "+1" * 5000, "a@b." * 3000]


def check(rows, got):
    want = sorted([(i, *brute(t)[:5]) for i, t in rows], key=repr)
    assert sorted([tuple(r)[:6] for r in got], key=repr) == want
    all_base = {(i, ",".join(brute(t)[5])) for i, t in rows}
    for r in got:
        if not r.n_added:
            assert (r.doc_id, r.spans) in all_base


def test_pattern_spans(spark):
    rows = list(enumerate(random_texts(1, 600) + LONG)) + [(9000, None), (9001, ""), (9002, "a@b.c"), (9002, "a@b.c"), (None, "x 1.2.3.4")]
    check(rows, pii.scan(docs(spark, rows)).collect())


def test_empty_table(spark):
    assert pii.scan(docs(spark, []), pii.fit(docs(spark, []))).collect() == []


@pytest.fixture(scope="module")
def corpus():
    """Phones and cards in context, wrong numbers, and phones without the plus sign."""
    rng = random.Random(4)
    rows = []
    for i in range(900):
        phone = f"1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        other = f"{rng.randrange(10**12, 10**13)}"
        kind = i % 3
        rows.append((i, f"please call phone +{phone} now" if kind == 0 else f"order number x{other}x of {rng.randrange(10**7, 10**8)}" if kind == 1 else f"éé some text {other} here"))
    return rows + [(5000 + k, f"please call phone 1 (321) 555-{1000 + k} now") for k in range(20)]


def test_trees_add_spans_and_keep_the_pattern_spans(spark, corpus):
    model = pii.fit(docs(spark, corpus))
    assert model.trees and set(model.thresholds) == {pii.KINDS.index("phone")}
    got = pii.scan(docs(spark, corpus), model).collect()
    check(corpus, got)
    for r in got:
        assert set(brute(dict(corpus)[r.doc_id])[5]) <= set(r.spans.split(",")) | {""}
    assert all(r.spans == "phone:18:34" and r.n_added == 1 for r in got if r.doc_id >= 5000)
    assert not any(r.n_added for r in got if r.doc_id < 5000)


def test_the_fit_reads_the_candidates_of_every_text(spark, corpus, monkeypatch):
    read = []
    monkeypatch.setattr(pii, "materialise", lambda df, name: read.append(df.localCheckpoint()) or read[-1])
    many = docs(spark, corpus).crossJoin(spark.range(40).toDF("copy")).selectExpr("doc_id", "concat(text, ' ', copy) AS text")
    pii.fit(many, rounds=1)
    # More candidates than any bound so far; each counts once.
    all_found = pii._with_candidates(pii._with_spans(many, "doc_id", "text", [])).select(F.sum(F.size("found"))).first()[0]
    assert all_found > 20_000 and read[0].agg(F.sum("weight")).first()[0] == all_found


def test_compiled_trees_equal_the_model(spark, corpus):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = pii._with_candidates(pii._with_spans(docs(spark, corpus), "doc_id", "text", [])).select(F.explode("found").alias("c")).select("c.x").distinct()
    df = df.withColumn("label", (F.xxhash64("x") % 2 == 0).cast("double")).withColumn("features", array_to_vector("x"))
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(df)
    booster = pii.Booster([(float(w), pii.read_tree(t.toDebugString)) for w, t in zip(model.treeWeights, model.trees)], {})
    rows = model.transform(df).select(vector_to_array("probability")[1].alias("a"), booster.score(F.col("x")).alias("b")).collect()
    assert rows and all(abs(r.a - r.b) < 1e-9 for r in rows)


def test_running_totals(spark):
    rows = [(list(range(n)),) for n in (0, 1, 127, 128, 129, 1000)]
    for r in spark.createDataFrame(rows, "a array<int>").select("a", pii.running_totals(F.col("a")).alias("s")).collect():
        assert r.s == [sum(r.a[: k + 1]) for k in range(len(r.a))]
