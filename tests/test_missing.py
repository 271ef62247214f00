"""The missing-value rules on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from sparkfeat.functions import (
    differs_or_missing,
    finite_or_zero,
    ieee_div,
    missing_interaction,
    nan_to_null,
    offset_ratio,
    positive_part,
    row_mean,
    row_product,
    row_sum,
    sentinel_to_null,
    with_row_stats,
)
from sparkfeat.operators.aggregate import aggregate

INF = math.inf


def values(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    "a, b, expected",
    [
        (1.0, 2.0, 0.5),
        (1.0, 0.0, INF),
        (-1.0, 0.0, -INF),
        (0.0, 0.0, None),
        (None, 0.0, None),
        (1.0, None, None),
        (None, None, None),
        (INF, INF, None),
        (INF, 2.0, INF),
    ],
)
def test_ieee_div(spark, a, b, expected):
    assert values(spark, "a double, b double", [(a, b)], ieee_div("a", "b")) == [expected]


def test_ieee_div_of_integers(spark):
    got = values(spark, "a int, b int", [(1, 0), (7, 2)], ieee_div("a", "b"))
    assert got == [INF, 3.5]


def test_filters_and_missing_values(spark):
    df = spark.createDataFrame([(261.0,), (None,), (5.0,), (300.0,)], "x double")
    assert [r.x for r in df.where(differs_or_missing("x", 261)).collect()] == [None, 5.0, 300.0]
    assert [r.x for r in df.where(F.col("x") < 300).collect()] == [261.0, 5.0]


def test_scalar_rules(spark):
    rows = [(3.0,), (-2.0,), (None,)]
    assert values(spark, "x double", rows, positive_part("x")) == [3.0, 0.0, 0.0]
    assert values(spark, "x int", [(365243,), (4,), (None,)], sentinel_to_null("x", 365243)) == [
        None, 4, None,
    ]
    messy = [(math.nan,), (INF,), (-INF,), (None,), (2.5,)]
    assert values(spark, "x double", messy, finite_or_zero("x")) == [0, 0, 0, 0, 2.5]
    assert values(spark, "x double", messy, nan_to_null("x")) == [None, INF, -INF, None, 2.5]


def test_pairs(spark):
    rows = [(0.5, 0.3), (None, 0.3), (0.5, None), (None, None)]
    ratios = values(spark, "a double, b double", rows, offset_ratio("a", "b"))
    assert ratios == [0.6 / 0.4, -0.9 / 0.4, 0.6 / -0.9, 1.0]
    got = values(spark, "a double, b double", rows, missing_interaction("a", "b"))
    assert got == [0.0, 0.3, 0.0, 0.0]


def test_row_statistics_of_missing_values(spark):
    schema, rows = "a double, b double", [(1.0, None), (None, None), (2.0, 4.0)]
    assert values(spark, schema, rows, row_sum(["a", "b"])) == [1.0, 0.0, 6.0]
    assert values(spark, schema, rows, row_mean(["a", "b"])) == [1.0, None, 3.0]
    assert values(spark, schema, rows, row_product(["a", "b"])) == [None, None, 8.0]
    df = with_row_stats(spark.createDataFrame(rows, schema), ["a", "b"], std="s", kurtosis="k")
    assert [(r.s, r.k) for r in df.collect()] == [(None, None), (None, None), (math.sqrt(2), None)]


def test_row_kurtosis_known_answers(spark):
    schema = "a int, b int, c int, d int, e int"
    rows = [(0, 0, 0, 1, 0), (2, 2, 2, 2, 2), (1, 2, None, None, 3), (1, 2, 9, None, 3)]
    df = with_row_stats(spark.createDataFrame(rows, schema), list("abcde"), kurtosis="k")
    got = [r.k for r in df.collect()]
    assert got[0] == pytest.approx(5.0) and got[1] == 0.0 and got[2] is None
    import pandas as pd

    assert got[3] == pytest.approx(pd.Series([1, 2, 9, 3]).kurt())


def test_empty_column_lists(spark):
    df = spark.createDataFrame([(1,)], "x int")
    row = with_row_stats(df.withColumns({"s": row_sum([]), "m": row_mean([])}), [], std="d").first()
    assert (row.s, row.m, row.d) == (0, None, None)


def test_group_aggregates_of_missing_and_infinite_values(spark):
    rows = [
        ("none", None), ("none", None), ("one", 2.0), ("inf", INF), ("inf", 1.0),
        ("both", INF), ("both", -INF), (None, 5.0),
    ]
    df = spark.createDataFrame(rows, "k string, x double")
    out = aggregate(df, "k", {"x": "min max mean sum var size nunique"}).collect()
    got = {r.k: r for r in out}
    assert set(got) == {"none", "one", "inf", "both"}
    none, one, inf, both = (got[k] for k in ("none", "one", "inf", "both"))
    assert (none.x_SUM, none.x_MEAN, none.x_MIN, none.x_VAR, none.x_SIZE) == (0.0, None, None, None, 2)
    assert (one.x_SUM, one.x_VAR, one.x_NUNIQUE) == (2.0, None, 1)
    assert (inf.x_MEAN, inf.x_SUM, inf.x_MAX, inf.x_VAR) == (INF, INF, INF, None)
    assert (both.x_MEAN, both.x_SUM, both.x_MIN) == (None, None, -INF)
    assert none.x_NUNIQUE == 0


def test_mean_without_sum_has_the_same_rules(spark):
    df = spark.createDataFrame([("a", INF), ("a", -INF), ("b", None), ("c", 3.0)], "k string, x double")
    got = {r.k: r.x_MEAN for r in aggregate(df, "k", {"x": "mean"}).collect()}
    assert got == {"a": None, "b": None, "c": 3.0}
