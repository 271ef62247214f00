"""What the physical plans of the central operators look like."""

import re

import pytest
from pyspark.sql import functions as F

from sparkfeat.operators import joins
from sparkfeat.operators.aggregate import Subset, aggregate
from sparkfeat.operators.encode import levels
from sparkfeat.registry import composites
from tests.conftest import final_plan


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text):
    return len(re.findall(r"Exchange hashpartitioning", text))


def test_assembly_moves_every_input_once(spark, small, no_broadcast):
    orders = spark.read.parquet(f"{small}/orders.parquet").withColumnRenamed("o_custkey", "k")
    customers = spark.read.parquet(f"{small}/customer.parquet").withColumnRenamed("c_custkey", "k")
    features = [aggregate(orders, "k", {"o_totalprice": f}, prefix=f) for f in ("min", "max", "sum")]
    assert shuffles(plan(joins.assemble(customers, "k", features))) == 4


def test_subsets_share_one_scan_and_one_shuffle(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    out = aggregate(
        orders,
        "o_custkey",
        {"o_totalprice": "min max mean sum var"},
        subsets=[Subset(s, f"o_orderstatus = '{s}'") for s in "FOP"],
    )
    text = plan(out)
    assert shuffles(text) == 1 and text.count("FileScan") == 1
    assert text.count("HashAggregate") == 2  # partial before the shuffle, final after it


def test_scan_reads_only_needed_columns_and_drops_missing_keys(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    out = aggregate(orders, "o_custkey", {"o_totalprice": "sum"})
    text = plan(out)
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in text
    assert "PushedFilters: [IsNotNull(o_custkey)]" in text


def test_category_filter_is_pushed_down(spark, small):
    from sparkfeat.operators.filters import keep_category

    orders = spark.read.parquet(f"{small}/orders.parquet")
    text = plan(keep_category(orders, "o_orderstatus", "F"))
    assert "EqualTo(o_orderstatus,F)" in text


def test_first_row_is_limited_before_the_shuffle(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    text = plan(joins.first_per_key(orders, "o_custkey", ["o_orderdate", "o_orderkey"]))
    assert re.search(r"WindowGroupLimit.*Partial", text) and shuffles(text) == 1
    below = text[text.index("Exchange") :]
    assert "WindowGroupLimit" in below


def test_distinct_count_shuffles_by_key_and_value(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    text = plan(aggregate(lines, "l_suppkey", {"l_quantity": "nunique"}))
    assert re.search(r"hashpartitioning\(l_suppkey#\d+L?, l_quantity#\d+", text)


def test_hot_keys_are_joined_by_broadcast(spark, no_broadcast):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"), "id"
    )
    out = joins.with_group_rate(rows, "k", F.col("id") > 5, total_as="n", hits_as="h", rate_as="r")
    text = final_plan(out)
    assert "BroadcastHashJoin" in text and "LeftAnti" in text


def test_wide_levels_are_counted_in_long_form(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet").select(
        "l_suppkey", F.col("l_quantity").cast("string").alias("q")
    )
    out = aggregate(lines, "l_suppkey", {}, rates=levels(lines, ["q"]))
    assert "pivotfirst" in plan(out)


def test_wide_columns_share_one_count(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet").select(
        "l_suppkey",
        F.col("l_quantity").cast("string").alias("q"),
        (F.col("l_orderkey") % 60).cast("string").alias("d"),
        (F.col("l_partkey") % 70).cast("string").alias("p"),
    )
    out = aggregate(lines, "l_suppkey", {}, rates=levels(lines, ["q", "d", "p"]))
    assert plan(out).count("FileScan") == 2


def test_roles_round_a_value_once_and_as_spark_does(spark, small):
    odd = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.2, -0.0, 2.0**51 + 0.5, -(2.0**52) + 0.5,
           2.0**53 + 2, 1e19, -1e300, 123456.49999999999, 7.0, float("inf"), float("-inf"), float("nan"), None]
    rows = spark.createDataFrame([(x,) for x in odd], "x double")
    got = rows.selectExpr("x", f"{composites.whole_number('x')} AS got", "round(x) AS want").collect()
    assert [repr(r.got) for r in got] == [repr(r.want) for r in got]
    for mapping in (composites.BUREAU, composites.PREVIOUS, composites.PAYMENTS, composites.CARDS, composites.APPLICATION):
        text = plan(composites.role(spark, small, mapping))
        assert "round(" not in text
    assert plan(composites.role(spark, small, composites.BUREAU)).count("SIGNUM(") == 1


def test_wide_tables_go_through_the_joins_as_one_value(spark):
    """Joins of the assembly copy a key and a struct a table; names, order, types and missing rows stay."""
    entities = spark.range(30).selectExpr("id * 3 AS e0", "id AS k", *[f"id + {i} AS `e.{i}`" for i in range(1, 20)])
    wide = spark.range(0, 40, 2).selectExpr("id AS k", *[f"nullif(id, 4) / {i} AS `w{i}`" for i in range(1, 40)])
    narrow = spark.range(0, 40, 3).selectExpr("id AS k", "id AS n")
    out = joins.assemble(entities, "k", [wide, narrow])
    plain = entities.join(wide, "k", "left").join(narrow, "k", "left")
    assert out.schema == plain.schema
    assert sorted(out.collect(), key=lambda r: r.k) == sorted(plain.collect(), key=lambda r: r.k)
    join = out._jdf.queryExecution().optimizedPlan().children().head()
    assert "Join" in join.nodeName() and join.output().length() == 5  # keys of both sides, two structs, n
