import random
import zlib

import pytest
from conftest import SF_MID
from llm_rows import docs, prose
from pyspark.sql import functions as F

from telespark.llm import quality
from telespark.llm.trees import Leaf, Split, holds, read_tree, rules, value
from telespark.sources.tables import read_table


@pytest.fixture(scope="module")
def tables(spark):
    return read_table(spark, SF_MID, "documents"), read_table(spark, SF_MID, "labels")


def test_held_out_accuracy(spark, tables):
    model = quality.fit(*tables)
    got = quality.classify(tables[0], model).join(tables[1], "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    good = [r for r in got if r.quality == 1]
    assert sum(r.predicted for r in good) >= 0.99 * len(good)
    assert model.weights and len(model.weights) < 100  # the lasso leaves few rules


def test_held_out_labels_and_other_columns_are_no_inputs(spark, tables):
    d, l = tables
    one = quality.fit(d, l)
    flipped = l.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = d.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    two = quality.fit(other, flipped)
    assert one == two


def test_odd_rows(spark, tables):
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (2, ""), (3, " \n "), (None, "word"), (4, prose(rng, 30_000)), (5, "x" * 300_000), (6, "| " * 50), (7, "One")]
    table = docs(spark, rows)
    model = quality.fit(*tables)
    got = quality.classify(table, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(table, model)
    assert kept.columns == table.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r.doc_id) for r in got if r.predicted)
    assert quality.classify(docs(spark, []), model).collect() == []


def test_labels_of_one_kind_or_none(spark):
    table = docs(spark, [(1, "a b"), (2, "c"), (11, "d")])
    labels = "doc_id long, quality int, toxic int"
    for rows, score in (([], 0.5), ([(1, 1, 0), (2, 1, 1)], 1.0), ([(1, 0, 0), (2, 0, 0)], 0.0), ([(None, 1, 0), (1, None, 0), (2, 7, 0)], 0.5)):
        got = quality.classify(table, quality.fit(table, spark.createDataFrame(rows, labels))).collect()
        assert all(abs(r.score - score) < 1e-9 for r in got)


def test_rules_are_the_paths(spark):
    text = """DecisionTreeModel
  If (feature 0 <= 0.5)
   If (feature 1 <= 2.0)
    Predict: 0.25
   Else (feature 1 > 2.0)
    Predict: -1.5
  Else (feature 0 > 0.5)
   Predict: 1.0E-4
"""
    tree = read_tree(text)
    assert tree == Split(0, 0.5, Split(1, 2.0, Leaf(0.25), Leaf(-1.5)), Leaf(1e-4))
    assert rules(tree) == {((0, "<=", 0.5),), ((0, ">", 0.5),), ((0, "<=", 0.5), (1, "<=", 2.0)), ((0, "<=", 0.5), (1, ">", 2.0))}
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 3.0), (1.0, 0.0)], "a double, b double")
    got = df.select(value(tree, [F.col("a"), F.col("b")]).alias("v"), holds(((0, "<=", 0.5), (1, ">", 2.0)), [F.col("a"), F.col("b")]).alias("r")).collect()
    assert [tuple(r) for r in got] == [(0.25, 0.0), (-1.5, 1.0), (1e-4, 0.0)]
