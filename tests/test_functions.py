"""Column helpers: R null rules, scalars, parsing."""

import datetime as dt
import math

from pyspark.sql import functions as F

from telespark.functions import (concat_label, count_if, in_set, make_point, mean_narm,
                                 n_clip, parse_timestamp, strict_mean, strict_sum, t_color)
from telespark.functions.time import cast_integer, cast_numeric


def test_in_set_never_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    got = [r[0] for r in df.select(in_set("x", ["a"])).collect()]
    assert got == [True, False, False]


def test_strict_aggregates_poison(spark):
    df = spark.createDataFrame([(1, 1.0, "Mole Hit"), (1, None, "Sample"), (2, 2.0, "Mole Hit"),
                                (2, 4.0, None)], "g int, v double, e string")
    got = {r.g: r for r in df.groupBy("g").agg(
        strict_sum("v").alias("s"), strict_mean("v").alias("m"),
        count_if(F.col("e") == "Mole Hit").alias("c"), mean_narm("v").alias("mn")).collect()}
    assert got[1].s is None and got[1].m is None and got[1].c == 1 and got[1].mn == 1.0
    assert got[2].s == 6.0 and got[2].m == 3.0 and got[2].c is None and got[2].mn == 3.0


def test_count_if_false_and_null_is_false(spark):
    # FALSE & NA is FALSE in R: a non-spawn row with missing x does not poison
    df = spark.createDataFrame([("Sample", None), ("Mole Spawned", 1.0)], "e string, x double")
    c = count_if((F.col("e") == "Mole Spawned") & (F.col("x") > 0))
    assert df.agg(c.alias("c")).first().c == 1
    df2 = spark.createDataFrame([("Mole Spawned", None), ("Mole Spawned", 1.0)], "e string, x double")
    assert df2.agg(c.alias("c")).first().c is None


def test_n_clip(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (2.0,), (None,), (float("nan"),)], "x double")
    got = [r[0] for r in df.select(n_clip("x")).collect()]
    assert got == [0.0, 0.5, 1.0, None, None]


def test_t_color_reference_example(spark):
    # the helper's own debug sample: x = .23, .45, .95, .01 -> g2, g2, g4, g1
    df = spark.createDataFrame([(0.23,), (0.45,), (0.95,), (0.01,), (2.0,), (None,)], "x double")
    got = [r[0] for r in df.select(t_color("x", [0, 0.2, 0.55, 0.85, 1.1],
                                           ["g0", "g1", "g2", "g3", "g4"])).collect()]
    assert got == ["g2", "g2", "g4", "g1", None, None]


def test_t_color_duplicate_level_takes_first(spark):
    df = spark.createDataFrame([(0.5,)], "x double")
    got = df.select(t_color("x", [0.0, 1.0, 1.0], ["a", "b", "c"])).first()[0]
    assert got == "b"


def test_concat_label(spark):
    df = spark.createDataFrame([(1.0, "CondA", None), (2.5, None, "0102")], "p double, c string, m string")
    got = [r[0] for r in df.select(concat_label("p", "c", "m")).collect()]
    assert got == ["1 CondA NA", "2.5 NA 0102"]


def test_make_point(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "x double, y double")
    got = df.select(make_point("x", "y").alias("p")).collect()
    assert got[0].p.x == 1.0 and got[1].p is None


def test_parse_timestamp(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05.123456",), ("2024-01-02 03:04:05",),
                                ("2024-01-02 03:04:05.5 CET",), ("garbage",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(parse_timestamp("t")).collect()]
    assert got[0] == dt.datetime(2024, 1, 2, 3, 4, 5, 123456)
    assert got[1] == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert got[2] == dt.datetime(2024, 1, 2, 3, 4, 5, 500000)
    assert got[3:] == [None, None, None]


def test_cast_numeric_and_integer(spark):
    df = spark.createDataFrame([("1.5",), (" -2 ",), ("1d",), ("abc",), ("1e3",), ("Inf",), ("3.7",), (None,)],
                               "t string")
    got = df.select(cast_numeric("t").alias("d"), cast_integer("t").alias("i")).collect()
    assert [r.d for r in got][:5] == [1.5, -2.0, None, None, 1000.0]
    assert math.isinf(got[5].d)
    assert [r.i for r in got] == [1, -2, None, None, 1000, None, 3, None]


def test_means_keep_small_and_infinite_values(spark):
    for values, want in (([2e-7, 2e-7], 2e-7), ([1.0, math.inf], math.inf), ([1.0, math.nan, None, 3.0], 2.0), ([1e14, 3e14], 2e14), ([None], None)):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        assert df.agg(mean_narm("x").alias("m")).first().m == want


def test_line_reaches_the_last_step(spark):
    from telespark.operators.fit import p_lin
    df = spark.createDataFrame([(0.0, 1.0), (0.29, 2.0)], "x double, y double")
    got = p_lin(df, "y", "x").orderBy("x").collect()
    assert len(got) == 30 and abs(got[-1].x - 0.29) < 1e-12 and abs(got[-1].y - 2.0) < 1e-9


def test_labels_keep_text_as_it_is(spark):
    df = spark.createDataFrame([(1.0, "2.0")], "p double, m string")
    assert df.select(concat_label("p", "m")).first()[0] == "1 2.0"
