import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfeat.operators.ranking import median, values_at_ranks
from sparkfeat.operators import ranking, split


def brute_median(values):
    v = sorted(values)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["a", "b"]),
            st.floats(-1e6, 1e6, allow_nan=False).map(lambda x: round(x, 3)) | st.sampled_from([0.0, 1.0, 1e-300]),
        ),
        min_size=1,
        max_size=25,
    )
)
def test_medians_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "g string, x double").coalesce(2)
    want = {g: brute_median([x for h, x in rows if h == g]) for g, _ in rows}
    assert {r.g: r.median for r in median(df, ["g"], "x").collect()} == want


def test_median_of_the_whole_table(spark):
    data = [random.Random(1).lognormvariate(5, 4) for _ in range(999)] + [math.inf, -math.inf, 3.0]
    df = spark.createDataFrame([(x,) for x in data] + [(None,)], "x double")
    assert median(df, [], "x").first()[0] == brute_median(data)


def test_missing_groups_and_values_are_left_out(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", None), ("a", 4.0), ("b", None)], "g string, x double")
    assert [tuple(r) for r in median(df, ["g"], "x").collect()] == [("a", 4.0)]


def test_one_group_holds_a_third_of_the_rows(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 500)).alias("g"),
        (F.col("id") * 7919 % 30011).cast("double").alias("x"),
    )
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median("x").alias("m")).collect()}
    got = {r.g: r.median for r in median(df, ["g"], "x").collect()}
    assert got == want


def test_ranks_outside_the_group_give_no_row(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    out = values_at_ranks(df, [], "x", lambda n: [F.lit(0), F.lit(2), F.lit(3)])
    assert [tuple(r) for r in out.collect()] == [(1, 2.0)]


def test_values_keep_their_type_and_any_distance(spark):
    df = spark.createDataFrame([(2**60,), (2**60 + 1,), (2**60 + 2,)], "x bigint")
    assert values_at_ranks(df, [], "x", lambda n: [F.lit(2)]).first()["value"] == 2**60 + 1
    data = [10.0 ** (i / 40 - 250) for i in range(20_001)]
    wide = spark.createDataFrame([(x,) for x in data], "x double")
    assert median(wide, [], "x").first()[0] == data[10_000]


def test_a_large_group_spans_many_parts(spark):
    df = spark.range(20_000).select(F.lit("a").alias("g"), (F.col("id") * 7919 % 20011).alias("x"))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # parts this small would be put together again
    try:
        ranked = ranking._in_parts(df.withColumnRenamed("x", "value"), ["g"], [F.count(F.lit(1)).alias("weight")])
        sizes = [r["count"] for r in ranked.groupBy("part").count().collect()]
        assert len(sizes) > 1 and max(sizes) < 15_000
        assert median(df, ["g"], "x").first()["median"] == df.agg(F.median("x")).first()[0]
    finally:
        spark.conf.unset(setting)


def test_stratified_split_is_exact_and_repeatable(spark):
    df = spark.range(1003).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"))
    one = split.stratified_split(df, "id", "y", 0.2)
    two = split.stratified_split(df.repartition(5, "id"), "id", "y", 0.2)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    counts = {(r.y, r.is_test): r["count"] for r in one.groupBy("y", "is_test").count().collect()}
    assert counts == {(1, True): 29, (1, False): 115, (0, True): 172, (0, False): 687}


def test_folds_are_disjoint_and_even(spark):
    df = spark.range(500).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    out = split.k_fold(df, "id", "y", 3)
    assert out.count() == 500 and out.where("fold IS NULL").count() == 0
    sizes = out.groupBy("y", "fold").count().collect()
    for y in (0, 1):
        per_fold = [r["count"] for r in sizes if r.y == y]
        assert len(per_fold) == 3 and max(per_fold) - min(per_fold) <= 1


def test_undersampling_keeps_the_small_class_whole(spark):
    df = spark.range(300).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    out = split.undersample(df, "id", "y")
    assert {r.y: r["count"] for r in out.groupBy("y").count().collect()} == {0: 30, 1: 30}


def test_hash_split_share(spark):
    out = split.hash_split(spark.range(20000), "id", 0.85)
    assert out.where("in_first").count() / 20000 == pytest.approx(0.85, abs=0.01)
    other = split.hash_split(spark.range(20000), "id", 0.85, seed=1)
    assert out.exceptAll(other).count() > 0


def test_group_columns_may_have_internal_names(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "rank string, x double")
    got = {r["rank"]: r.median for r in median(df, ["rank"], "x").collect()}
    assert got == {"a": 2.0, "b": 5.0}
    with pytest.raises(ValueError, match="slot or value"):
        median(df, ["value"], "x")


def test_portable_numbers_equal_the_digest(spark):
    import hashlib

    rows = spark.range(50).select("id", split.hash_number("id", portable=True).alias("n")).collect()
    for r in rows:
        assert r.n == int(hashlib.md5(f"314:{r.id}".encode()).hexdigest()[:13], 16)
    fast = spark.range(1000).select(split.hash_number("id").alias("n"))
    assert fast.where("n < 0 OR n >= pow(2, 52)").count() == 0 and fast.distinct().count() == 1000
