"""What is kept between passes: statistics, states, sketches, buckets, vectors, records, stages."""

import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sparkfeat.operators import fitted, profile, sparse, states
from sparkfeat.operators.aggregate import aggregate, distinct_sketches, sketch_counts, unite_sketches
from sparkfeat.operators.observed import convert_observed, with_statistics
from sparkfeat.registry import stored
from sparkfeat.sources.store import Stages, intermediate_tables, materialize, store_bucketed
from sparkfeat.sources.tables import csv_records, csv_texts, infer_types
from tests.conftest import final_plan

ROWS = [
    (1, 70000.5, None, 3, "a"), (2, -9.0, None, None, None), (2, None, None, -200, "b"),
    (3, 80000.0, None, 7, "a"), (None, 1.0, None, 2**40, ""),
]
SCHEMA = "k long, x double, nothing double, i long, s string"


def jobs(spark, group, action):
    """The number of jobs that an action starts."""
    spark.sparkContext.setJobGroup(group, group)
    result = action()
    count = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "rest")
    return count, result


def test_observed_statistics_equal_those_of_scans(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    table, seen = with_statistics(df)
    assert seen.rows == 5 and sorted(map(str, table.collect())) == sorted(map(str, df.collect()))
    assert seen.classes() == profile.type_classes(df)
    want = {r.column_name: tuple(r) for r in profile.range_profile(df).collect()}
    assert {r.column_name: tuple(r) for r in seen.profile(spark).collect()} == want
    clip, again = seen.clip(), fitted.fit_sigma_clip(df)
    assert clip.keys() == again.keys() == {"x"}
    assert clip["x"] == {k: pytest.approx(v) for k, v in again["x"].items()}
    assert seen.means(["x", "nothing"]) == fitted.fit_mean(df, ["x", "nothing"])
    assert seen.min_max() == fitted.fit_min_max(df)
    assert seen.columns["i"]["present"] == 4 and seen.columns["nothing"]["present"] == 0
    assert seen.check_rows(5) == 5
    with pytest.raises(ValueError, match="from 5 to 4"):
        seen.check_rows(4)


def test_observed_statistics_of_cleaned_and_empty_tables(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    _, seen = with_statistics(df, {"x": F.nullif(F.col("x"), F.lit(-9.0))})
    assert seen.columns["x"]["low"] == 1.0 and seen.columns["x"]["present"] == 3
    _, none = with_statistics(df.limit(0))
    assert none.rows == 0 and none.clip() == {} and none.means(["x"]) == {"x": {"fill": None}}
    assert fitted.apply_min_max(df, none.min_max()).count() == 5
    words, only = with_statistics(df.select("s"))
    assert only.rows == 5 and only.columns == {} and words.count() == 5


def test_conversion_and_statistics_take_one_pass(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,listed,free,word,whole\n1,2.5,7,x,1\n2,NA,nan,NULL,2\n3,400000,9,y,3\n")
    types = {"id": "bigint", "listed": "double"}
    texts = csv_texts(spark, str(path))
    kinds = infer_types(texts, ["free", "word", "whole"])
    count, (table, seen) = jobs(spark, "convert", lambda: convert_observed(texts, types))
    assert count == 1
    path.unlink()
    count, found = jobs(spark, "statistics", lambda: (seen.clip(), seen.classes(), seen.means(["free"]), seen.rows))
    assert count == 0 and found[3] == 3 and found[2] == {"free": {"fill": 8.0}}
    assert list(found[0]) == ["listed"] and found[1]["whole"] == "int8"
    assert {f.name: f.dataType.simpleString() for f in table.schema} == {**types, **kinds}
    assert kinds == {"free": "double", "word": "string", "whole": "bigint"}
    assert [tuple(r) for r in table.orderBy("id").collect()] == [
        (1, 2.5, 7.0, "x", 1), (2, None, None, None, 2), (3, 400000.0, 9.0, "y", 3)
    ]
    assert "word" not in seen.columns


VALUES = st.one_of(st.none(), st.integers(-50, 50).map(float), st.sampled_from([math.inf, 1e9, math.nan]))
PARTS = st.lists(st.lists(st.tuples(st.sampled_from([1, 2, None]), VALUES), max_size=6), min_size=1, max_size=4)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(PARTS)
def test_merged_states_equal_one_pass(spark, parts):
    spec = {"x": "min max mean sum var size"}
    frames = [spark.createDataFrame(p, "k long, x double") for p in parts]
    whole = spark.createDataFrame([r for p in parts for r in p], "k long, x double")
    whole = whole.withColumn("x", F.nanvl("x", F.lit(None)))
    merged = states.merge_states([states.partial_state(f, "k", ["x"]) for f in frames], "k")
    got = states.finish(merged, "k", spec, prefix="P", count_as="n").toPandas().set_index("k").sort_index()
    want = aggregate(whole, "k", spec, prefix="P", count_as="n").toPandas().set_index("k").sort_index()
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)


def test_variance_of_far_values_survives_merging(spark):
    frames = [
        spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") % 7 + part + 1e9).alias("x")) for part in range(3)
    ]
    merged = states.merge_states([states.partial_state(f, "k", ["x"]) for f in frames], "k")
    got = states.finish(merged, "k", {"x": "var"}).first()["x_VAR"]
    values = pd.Series([i % 7 + part for part in range(3) for i in range(1000)], dtype=float)
    assert got == pytest.approx(values.var(), rel=1e-6)


def test_stored_parts_are_replaced_not_added(spark, tmp_path):
    folder = str(tmp_path / "states")
    df = spark.createDataFrame(ROWS, SCHEMA)
    levels = {"s": ["a", None]}
    for part in ("old", "new", "new"):
        states.append_state(states.partial_state(df, "k", ["x", "i"], levels), folder, part)
    state = states.merged_state(spark, folder, "k")
    got = states.finish(state, "k", {"i": "sum max"}, levels=levels, count_as="n").orderBy("k").collect()
    assert [tuple(r) for r in got] == [
        (1, 6, 3, 1.0, 0.0, 2), (2, -400, -200, 0.0, 0.5, 4), (3, 14, 7, 1.0, 0.0, 2)
    ]
    assert state.schema["i"].dataType["sum"].dataType.simpleString() == "bigint"
    with pytest.raises(ValueError, match="median"):
        states.finish(state, "k", {"x": "median"})


def test_sketches_unite_over_parts(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 5).alias("m"), (F.col("id") % 7919).alias("x"))
    fine = distinct_sketches(rows, ["k", "m"], ["x"])
    half = [distinct_sketches(rows.where(F.col("x") % 2 == i), "k", ["x"]) for i in (0, 1)]
    whole = {r.k: r.x_NUNIQUE for r in sketch_counts(distinct_sketches(rows, "k", ["x"]), ["x"]).collect()}
    for parts in (fine.select("k", "x"), half[0].unionByName(half[1])):
        found = sketch_counts(unite_sketches(parts, "k", ["x"]), ["x"]).collect()
        for r in found:
            assert abs(r.x_NUNIQUE - 7919) <= 0.08 * 7919 and abs(r.x_NUNIQUE - whole[r.k]) <= 0.02 * 7919


def test_assembly_of_buckets_has_no_exchange(spark, small):
    df = stored.bucketed_assembly(spark, small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = final_plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and "Exchange" not in plan


def test_bucketed_tables_are_removed(spark):
    before = {t.name for t in spark.catalog.listTables()}
    with intermediate_tables(spark):
        table = store_bucketed(spark.range(10).toDF("k"), "k", 4)
        assert table.count() == 10
        assert len({t.name for t in spark.catalog.listTables()} - before) == 1
    assert {t.name for t in spark.catalog.listTables()} == before


def test_levels_beyond_columns_become_sparse_vectors(spark):
    rows = [(1, "b", "x"), (1, "a", None), (1, "b", None), (2, None, "x"), (None, "a", "x"), (4, "zz", None)]
    df = spark.createDataFrame(rows, "k long, c string, d string")
    assert sparse.wide_columns(df, 2) == ["c"] and sparse.wide_columns(df.select("k"), 0) == []
    rates, found = sparse.wide_rates({"t": df}, {"t": ["c", "d"], "other": []}, "k")
    index = sparse.level_index(found.where("level IS DISTINCT FROM 'zz'"))
    # t.c: a, b, missing; t.d: x, missing
    assert index.size == 5
    keys = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k long")
    vectors = keys.join(sparse.sparse_vectors(rates, "k", index), "k", "left")
    vectors = vectors.withColumn("levels", sparse.or_empty(F.col("levels"), index.size))
    table = materialize(vectors, "v", vectors=["levels"])
    got = {r.k: [round(v, 6) for v in r.levels.toArray()] for r in table.collect()}
    third = round(1 / 3, 6)
    assert got == {
        1: [third, round(2 / 3, 6), 0, third, round(2 / 3, 6)], 2: [0, 0, 1, 1, 0], 3: [0] * 5, 4: [0, 0, 0, 0, 1],
    }
    assert sparse.entries(table, "k", "levels").where("k = 3").count() == 0
    assembled = Pipeline(stages=[VectorAssembler(inputCols=["k", "levels"], outputCol="f")]).fit(table).transform(table)
    assert {r.f.size for r in assembled.collect()} == {6}


def test_records_that_do_not_parse_are_kept_apart(spark, tmp_path):
    path = tmp_path / "r.csv"
    text = 'a,b,c\n1,"two\nlines, ""quoted""",2.5\nx,y,3\n4,short\n5,"\r\n",nan\n6, blank ,1e3\n7,b,c,d\n8,NA,zz\n'
    path.write_bytes(text.encode())
    good, bad = csv_records(spark, str(path), {"a": "bigint", "b": "string", "c": "double"})
    assert sorted(tuple(r) for r in good.collect()) == [
        (1, 'two\nlines, "quoted"', 2.5), (5, "\r\n", None), (6, " blank ", 1000.0)
    ]
    found = sorted((r.reason, r.record) for r in bad.collect())
    assert [(r, t.split(",")[0]) for r, t in found] == [("a", "x"), ("c", "8"), ("fields", "4"), ("fields", "7")]


def test_stages_are_found_again_by_input_and_options(spark, tmp_path):
    source = tmp_path / "in.txt"
    source.write_text("one")
    built = []

    def build(path):
        built.append(path)
        return materialize(spark.range(3).toDF("x"), path=path)

    first = Stages(spark, [str(source)], "o")
    assert first.finished("t") is None and first.table("t", build).count() == 3
    again = Stages(spark, [str(source)], "o")
    assert again.table("t", build).count() == 3 and len(built) == 1
    assert Stages(spark, [str(source)], "p").root != first.root
    source.write_text("other")
    assert Stages(spark, [str(source)], "o").root != first.root

    def stopped(path):
        materialize(spark.range(5).toDF("x"), path=path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        again.table("u", stopped)
    assert again.finished("u") is None and again.table("u", build).count() == 3
    again.remove()
    assert again.finished("t") is None
