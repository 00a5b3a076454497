"""Every stage of the corpus pipeline on what its predecessor kept."""

from collections import Counter

import pytest
from conftest import SF_SMALL

import corpus_pipeline
from telespark.llm import mixing, quality
from telespark.llm.common import materialise
from telespark.sources.tables import read_table
from test_llm_near_dedup import brute as near_groups


@pytest.fixture(scope="module")
def stages(spark):
    docs = [read_table(spark, SF_SMALL, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(materialise(stage(spark, docs[-1], SF_SMALL), "test"))
    return docs


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_quality_keeps_what_it_predicts(spark, stages):
    model = quality.fit(stages[0], read_table(spark, SF_SMALL, "labels"))
    assert ids(stages[1]) == ids(quality.classify(stages[0], model).where("predicted = 1"))


def test_one_of_each_text(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    best = {}
    for i, t in rows:
        t = (t or "").translate(lower)
        best[t] = min(i, best.get(t, i))
    assert ids(stages[2]) == sorted(best.values())


def test_one_of_each_near_group(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert ids(stages[3]) == sorted(i for i, _, _, kept in near_groups(rows, 5, 80) if kept)


def test_mixing_keeps_its_sample(stages):
    mixed = mixing.mix(stages[3], corpus_pipeline.margins(), corpus_pipeline.FRACTION)
    assert ids(stages[4]) == sorted(r.doc_id for r in mixed.where("kept").select("row.doc_id").collect())


def test_packing_holds_every_token(stages):
    want = {r.doc_id: len((r.text or "").split()) for r in stages[4].collect()}
    got = Counter()
    for r in stages[5].collect():
        got[r.doc_id] += r.n_tokens
    assert got == want


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert sorted(map(tuple, got.select("doc_id", "piece", "n_tokens").collect())) == sorted(map(tuple, stages[5].select("doc_id", "piece", "n_tokens").collect()))


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns; then no rows at all."""
    import random

    from llm_rows import docs, edited, prose

    rng = random.Random(8)
    text = prose(rng, 300)
    rows = [(1, text), (1, text), (2, text), (3, edited(rng, text, 2)), (4, None), (5, ""), (None, "word"), (None, None), (6, prose(rng, 30_000)), (7, "x" * 200_000)]
    rows += [(100 + i, prose(rng, rng.randrange(1, 80))) for i in range(60)]
    table = docs(spark, rows).selectExpr("*", "CASE WHEN doc_id > 120 THEN 'en' END AS lang", "CASE WHEN doc_id > 110 THEN 'src0' END AS source", "CAST(NULL AS LONG) AS n_chars")
    labels = [(1, 1, 0), (100, 0, None), (101, 0, 1), (102, None, 0), (None, 1, 0), (103, 1, 0), (103, 0, 0)]
    for k, df in enumerate((table, table.limit(0))):
        sf_dir = f"{tmp_path}/{k}"
        df.write.parquet(f"{sf_dir}/documents.parquet")
        spark.createDataFrame(labels if not k else [], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
        got = read_table(spark, sf_dir, "documents")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = materialise(stage(spark, got, sf_dir), "test")
            assert got.columns == df.columns, name
        packed = corpus_pipeline.STAGES[-1][1](spark, got, sf_dir).collect()
        tokens = sum(len((r.text or "").split()) for r in got.collect())
        assert sum(r.n_tokens for r in packed) == tokens
        if not k:
            kept = [r.doc_id for r in got.collect()]
            assert len([i for i in kept if i in (1, 2, 3)]) <= 1
        else:
            assert packed == []
