from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.sources.tables import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query under a name, with the equivalent SQL where there is one."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


# What a query has trained, for the queries that state facts on it: nothing is trained twice.
_kept: dict[tuple, object] = {}


def kept(spark: SparkSession, sf: str, tables, name: str, build, again: bool = False):
    """The result of ``build``, made once for a session and the files of some of a folder's tables.

    With ``again`` it is made anew, and what is kept is replaced.
    """
    files = [f for t in tables for f in sorted(load_table(spark, sf, t).inputFiles())]
    key = (spark.sparkContext.applicationId, name, *files)
    if again or key not in _kept:
        _kept[key] = build()
    return _kept[key]


def cents(column: str) -> Column:
    """Money as whole cents, so that sums and means do not depend on the order of rows."""
    return F.rint(F.col(column) * 100).cast("double")


def sql_cents(column: str) -> str:
    return f"CAST(round({column} * 100) AS DOUBLE)"


def inside(value: Column) -> Column:
    """A finite value, or NULL: infinities are reported by their class instead."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def number_class(value: Column) -> Column:
    return (
        F.when(value.isNull(), "missing")
        .when(value == F.lit(float("inf")), "+inf")
        .when(value == F.lit(float("-inf")), "-inf")
        .otherwise("finite")
    )


# Missing values are injected by the same rule on both sides; the tables hold none.
def orders_with_gaps(orders: DataFrame) -> DataFrame:
    """Orders with some missing customers, states and prices; customers without any price."""
    return orders.select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 97 != 0, F.col("o_custkey")).alias("client"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(
            (F.col("o_custkey") % 50 != 0) & (F.col("o_orderkey") % 5 != 0), cents("o_totalprice")
        ).alias("price"),
        F.datediff("o_orderdate", F.lit("1995-01-01")).alias("day"),
        F.col("o_orderpriority").alias("priority"),
    )


ORDERS_WITH_GAPS = f"""
SELECT o_orderkey,
       CASE WHEN o_custkey % 97 <> 0 THEN o_custkey END AS client,
       CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status,
       CASE WHEN o_custkey % 50 <> 0 AND o_orderkey % 5 <> 0
            THEN {sql_cents("o_totalprice")} END AS price,
       CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day,
       o_orderpriority AS priority
FROM orders
"""


def lines_with_gaps(lines: DataFrame) -> DataFrame:
    """Line items with some missing quantities, discounts and taxes."""
    return lines.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        F.nullif("l_quantity", F.lit(13.0)).alias("quantity"),
        F.when(F.col("l_partkey") % 3 != 0, F.col("l_discount")).alias("discount"),
        F.when(F.col("l_suppkey") % 4 != 0, F.col("l_tax")).alias("tax"),
    )


LINES_WITH_GAPS = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       nullif(l_quantity, 13.0) AS quantity,
       CASE WHEN l_partkey % 3 <> 0 THEN l_discount END AS discount,
       CASE WHEN l_suppkey % 4 <> 0 THEN l_tax END AS tax
FROM lineitem
"""

LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def sql_ratio(a: str, b: str) -> str:
    """IEEE ratio in SQL: infinite for x/0, NULL for 0/0 and for a missing operand."""
    return (
        f"CASE WHEN ({b}) = 0 THEN CASE WHEN ({a}) > 0 THEN 'infinity'::DOUBLE "
        f"WHEN ({a}) < 0 THEN '-infinity'::DOUBLE END ELSE ({a}) / ({b}) END"
    )


def sql_finite(value: str) -> str:
    return f"CASE WHEN isfinite({value}) THEN {value} END"


def sql_class(value: str) -> str:
    return (
        f"CASE WHEN ({value}) IS NULL THEN 'missing' WHEN isinf({value}) AND ({value}) > 0 THEN '+inf' "
        f"WHEN isinf({value}) THEN '-inf' ELSE 'finite' END"
    )
