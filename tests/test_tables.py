"""Sources, profiles, encoding, fitted transforms and joins."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkfeat.operators import columns, encode, expand, fitted, joins, profile
from sparkfeat.sources import store, tables


def test_csv_tokens_types_and_garbage(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,a,b,c,d\n1,NA,x,1.5,7\n2,,XNA,nan,8\n3,5,None,-2e3,9\n")
    df = tables.read_csv(spark, str(path), {"id": "bigint"})
    assert dict(df.dtypes) == {"id": "bigint", "a": "double", "b": "string", "c": "double", "d": "bigint"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, None, "x", 1.5, 7), (2, None, "XNA", None, 8), (3, 5.0, None, -2000.0, 9),
    ]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.read_csv(spark, str(path), {"b": "int"}).collect()


def test_infer_types_of_an_all_missing_column(spark):
    rows = [(None, "1", "-inf", "1e3", "9223372036854775808", "1.2.3", "."),
            (None, "+22", ".5", "-7.", "1", "4", "1")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string")
    assert tables.infer_types(df, df.columns) == {
        "a": "double", "b": "bigint", "c": "double", "d": "double", "e": "double", "f": "string",
        "g": "string",
    }
    assert tables.infer_types(df, []) == {}


def test_scratch_dir_follows_the_session(spark):
    assert store.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_bucketed_feature_table_joins_without_a_shuffle(spark, tmp_path, monkeypatch):
    wide = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    tables.write_features(wide, str(tmp_path / "f"), bucket_by="k", buckets=4, table="feature_table")
    stored = spark.table("feature_table")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = stored.join(stored.withColumnRenamed("x", "y"), "k")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE feature_table")
    assert "Exchange hashpartitioning" not in plan
    with pytest.raises(ValueError):
        tables.write_features(wide, str(tmp_path / "g"), bucket_by="k")


def test_type_classes_use_open_intervals(spark):
    df = spark.createDataFrame(
        [(-127, 126, 127, 1.0, 65504.0, None)], "a int, b int, c int, d double, e double, f double"
    )
    classes = profile.type_classes(df)
    assert classes == {
        "a": "int8", "b": "int8", "c": "int16", "d": "float16", "e": "float32", "f": "float64",
    }
    assert [t for _, t in profile.narrow(df).dtypes] == [
        "tinyint", "tinyint", "smallint", "double", "double", "double",
    ]


def test_column_tools(spark):
    df = spark.createDataFrame([(1, 2, 3.0)], "`a.b` int, FLAG_DOC int, x double")
    assert columns.drop_lenient(df, ["a.b", "nope"]).columns == ["FLAG_DOC", "x"]
    with pytest.raises(KeyError):
        columns.drop_strict(df, "nope")
    assert columns.plain_names(df).columns == ["a_b", "FLAG_DOC", "x"]
    assert columns.names_containing(df, "FLAG_", without=["_FLAG_"]) == ["FLAG_DOC"]
    messy = spark.createDataFrame([(math.inf, None, None), (1.0, 2, "s")], "`a.b` double, i int, t string")
    assert [tuple(r) for r in columns.fill_final(messy).collect()] == [(0.0, 0, None), (1.0, 2, "s")]
    assert [tuple(r) for r in columns.missing_to_zero(columns.infinite_to_zero(messy)).collect()] == [
        (0.0, 0, None), (1.0, 2, "s"),
    ]


def test_shape_guard(spark):
    left = spark.range(3)
    assert profile.shape(left) == (3, 1)
    with pytest.raises(ValueError, match="row count"):
        profile.check_same_rows(left, left.union(left))


def test_one_hot_equals_get_dummies(spark):
    data = pd.DataFrame({"k": [1, 2, 3], "s": ["b", None, "a"]})
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "k int, s string")
    out, names = encode.one_hot(df, encode.levels(df))
    want = pd.get_dummies(data, columns=["s"], dummy_na=True, dtype=int)
    assert out.columns == list(want.columns) and names == ["s_a", "s_b", "s_nan"]
    assert [tuple(r) for r in out.orderBy("k").collect()] == [tuple(r) for r in want.values.tolist()]
    plain, _ = encode.one_hot(df, encode.levels(df), null_level=False)
    assert plain.columns == ["k", "s_a", "s_b"]
    assert out.select(sum(F.col(n) for n in names)).distinct().collect() == [(1,)]


def test_too_many_levels_raise(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("s"))
    with pytest.raises(ValueError, match="levels"):
        encode.levels(df, max_levels=10)


def test_alignment_keeps_shared_columns_and_the_label(spark):
    train = spark.createDataFrame([(1, "a", 1, 0.5), (2, "b", 0, 0.1)], "k int, s string, y int, only double")
    test = spark.createDataFrame([(3, "b"), (4, "c")], "k int, s string")
    left, right = encode.align(train, test, "y")
    assert left.columns == ["k", "y", "s_b"] and right.columns == ["k", "s_b"]
    assert sorted(map(tuple, right.collect())) == [(3, 1), (4, 0)]


def test_bins_equal_pandas_cut(spark):
    xs = [19.0, 20.0, 20.1, 25.0, 25.01, 44.9, 70.0, 70.1, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    number = expand.equal_width_bin("x", 20.0, 70.0, 10)
    labels = expand.bin_labels(20.0, 70.0, 10)
    got = [tuple(r) for r in df.select(number, expand.bin_label(number, labels)).collect()]
    edges = [20.0 + 5 * i for i in range(11)]
    cut = pd.cut(pd.Series(xs, dtype=float), bins=edges)
    want = [(None, None) if c < 0 else (c + 1, str(i)) for c, i in zip(cut.cat.codes, cut)]
    assert got == want


def test_polynomials(spark):
    df = spark.createDataFrame([(2.0, 3.0, 5.0, 7.0)], "a double, b double, c double, d double")
    out = expand.with_polynomials(df, list("abcd"))
    assert len(out.columns) == 4 + 30
    row = out.first()
    assert (row["a^2"], row["a b"], row["a b c"], row["b^2 d"], row["d^3"]) == (4.0, 6.0, 30.0, 63.0, 343.0)


def test_sigma_clip_bounds(spark):
    xs = [float(i % 10) for i in range(200)] + [1e6, -1e6, None]
    df = spark.createDataFrame([(x, 5) for x in xs], "x double, SK_ID_N int")
    stats = fitted.fit_mean_std(df, ["x"])
    mean, std = stats["x"]["mean"], stats["x"]["std"]
    series = pd.Series([x for x in xs if x is not None])
    assert (mean, std) == (pytest.approx(series.mean()), pytest.approx(series.std()))
    got = [r.x for r in fitted.apply_sigma_clip(df, stats, trigger=3.5).collect()]
    assert got[-3:] == [mean + 3 * std, mean - 3 * std, None] and got[:-3] == xs[:-3]
    assert list(fitted.fit_sigma_clip(df.withColumn("SK_ID_F", F.col("x")).withColumn("y", F.lit(1.0)))) == ["x"]


def test_fitted_statistics_survive_storage(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "x double, y double")
    stats = fitted.fit_min_max(df)
    assert stats == {"x": {"low": 1.0, "high": 3.0}, "y": {"low": 0.0, "high": 0.0}}
    assert fitted.read_stats(fitted.stats_table(spark, stats)) == stats
    other = spark.createDataFrame([(2.0, math.inf), (None, 4.0)], "x double, y double")
    assert [tuple(r) for r in fitted.apply_min_max(other, stats).collect()] == [(0.5, 0.0), (-0.5, 4.0)]
    assert fitted.fit_median(df, ["x", "y"]) == {"x": {"fill": 2.0}, "y": {"fill": None}}


def test_group_rate_with_hot_and_missing_keys(spark):
    df = spark.range(6000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, None).otherwise(F.col("id")).alias("k"),
        (F.col("id") % 2).alias("hit"),
    )
    out = joins.with_group_rate(df, "k", F.col("hit") == 1, total_as="n", hits_as="h", rate_as="r")
    assert out.count() == 6000
    assert out.where("k = 0").select("n", "h", "r").distinct().collect() == [(2000, 1000, 0.5)]
    assert out.where("k IS NULL").select("n", "h", "r").distinct().collect() == [(None, None, None)]
    cold = out.where("k > 0")
    assert cold.count() == 2000 and cold.where("n <> 1").count() == 0
    assert cold.where("hit = 0 AND h IS NULL AND r IS NULL").count() == cold.where("hit = 0").count()


def test_lookup_beyond_the_broadcast_bound(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("k"))
    table = spark.range(8).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small = sorted(map(str, joins.lookup(df, table, "k").collect()))
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "1")
        assert sorted(map(str, joins.lookup(df, table, "k").collect())) == small
    finally:
        spark.conf.set(setting, before)


def test_assembly_keeps_rows_and_refuses_overlaps(spark):
    entities = spark.range(4).withColumnRenamed("id", "k")
    feature = spark.createDataFrame([(0, 1.0), (9, 2.0)], "k long, x double")
    assert joins.assemble(entities, "k", [feature]).count() == 4
    with pytest.raises(ValueError, match="collide"):
        joins.assemble(entities, "k", [feature, feature])
    with pytest.raises(ValueError, match="shared"):
        joins.join_shared(entities, spark.range(1))


def test_text_of_a_table_is_parsed_once(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,listed,free,word\n1,2.5,7,x\n2,NA,nan,NULL\n3,4,9,y\n")
    types = {"id": "bigint", "listed": "double"}
    got = tables.convert_csv(spark, str(path), types)
    assert got.schema == tables.read_csv(spark, str(path), types).schema
    assert got.collect() == tables.read_csv(spark, str(path), types).collect()
    assert "csv" not in got._jdf.queryExecution().executedPlan().toString().lower().split("location")[0]
    assert [f for f in got.inputFiles() if f.endswith(".csv")] == []


def test_columns_of_every_table_have_one_type():
    from sparkfeat.sources.schemas import TABLE_FILES, TABLE_TYPES, known_types

    assert set(TABLE_TYPES) == set(TABLE_FILES)
    for table, kinds in TABLE_TYPES.items():
        assert len(known_types(table)) == sum(len(names.split()) for names in kinds.values())


def test_intermediate_tables_are_removed(spark):
    from pathlib import Path

    from sparkfeat.sources.store import intermediate_tables, materialize

    outside = materialize(spark.range(3).toDF("x"))
    with intermediate_tables(spark):
        inside = materialize(spark.range(4).toDF("x"))
        folder = Path(inside.inputFiles()[0].removeprefix("file://")).parent
        assert inside.count() == 4 and folder.exists()
    assert not folder.exists() and outside.count() == 3
