"""Top-k reports and repeatable splits; the splits use the hash that SQL can reproduce."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfeat.operators import split
from sparkfeat.operators.model import last_k, top_k
from sparkfeat.operators.ranking import values_at_ranks
from sparkfeat.registry.base import register
from sparkfeat.sources.tables import load_table


def _hash(key):
    return f"('0x' || substr(md5('314:' || {key}), 1, 13))::BIGINT"


@register(
    "top_k",
    "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20",
)
def _(spark, sf):
    part = load_table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return top_k(part, "p_retailprice", "p_partkey", 20)


@register(
    "last_k",
    """SELECT p_partkey, p_name, p_retailprice FROM (SELECT * FROM part
       ORDER BY p_retailprice DESC, p_partkey LIMIT 5) ORDER BY p_retailprice, p_partkey DESC""",
)
def _(spark, sf):
    part = load_table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return last_k(part, "p_retailprice", "p_partkey", 5)


_RANKED_ORDERS = f"""
SELECT o_orderkey, o_orderstatus,
       row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_hash("o_orderkey")}) AS r,
       count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders
"""


@register(
    "stratified_split",
    f"""SELECT o_orderkey, o_orderstatus, r <= floor(n * 0.2::DOUBLE + 0.5) AS is_test
        FROM ({_RANKED_ORDERS})""",
)
def _(spark, sf):
    orders = load_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return split.stratified_split(orders, "o_orderkey", "o_orderstatus", 0.2, portable=True)


@register(
    "stratified_split_large",
    f"""SELECT o_orderkey, o_orderstatus, r <= floor(n * 0.2::DOUBLE + 0.5) AS is_test
        FROM ({_RANKED_ORDERS})""",
)
def _(spark, sf):
    """The same split of the rows in another order: only ids and classes matter."""
    orders = load_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return split.stratified_split(
        orders.repartition("o_orderkey"), "o_orderkey", "o_orderstatus", 0.2, portable=True
    )


@register(
    "kfold",
    f"""SELECT o_orderkey, o_orderstatus,
               CASE WHEN r <= floor(n * 1 / 3.0::DOUBLE) THEN 0
                    WHEN r <= floor(n * 2 / 3.0::DOUBLE) THEN 1 ELSE 2 END AS fold
        FROM ({_RANKED_ORDERS})""",
)
def _(spark, sf):
    orders = load_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return split.k_fold(orders, "o_orderkey", "o_orderstatus", 3, portable=True)


@register(
    "hash_split",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
               {_hash("l_orderkey")} < CAST(round(0.85 * 4503599627370496) AS BIGINT) AS in_first
        FROM lineitem""",
)
def _(spark, sf):
    lines = load_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"
    )
    return split.hash_split(lines, "l_orderkey", 0.85, portable=True)


@register(
    "undersample",
    f"""SELECT doc_id, quality FROM (
          SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_hash("doc_id")}) AS r
          FROM labels)
        WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""",
)
def _(spark, sf):
    labels = load_table(spark, sf, "labels").select("doc_id", "quality")
    return split.undersample(labels, "doc_id", "quality", portable=True)


@register(
    "group_median_wide",
    """SELECT o_orderpriority, value FROM (
           SELECT o_orderpriority, value,
                  row_number() OVER (PARTITION BY o_orderpriority ORDER BY value) AS r,
                  count(*) OVER (PARTITION BY o_orderpriority) AS n
           FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey
                        ELSE 1152921504606846976 + o_orderkey * o_orderkey END AS value FROM orders))
       WHERE r = (n + 1) // 2""",
)
def _(spark, sf):
    """Middle values of groups that reach from 1 to above 2**60, exact as whole numbers."""
    orders = load_table(spark, sf, "orders")
    key = F.col("o_orderkey")
    value = F.when(key % 2 == 0, key).otherwise(F.lit(2**60) + key * key)
    rows = orders.select("o_orderpriority", value.alias("wide"))
    found = values_at_ranks(
        rows, ["o_orderpriority"], "wide", lambda n: [F.floor((n + 1) / 2)]
    )
    return found.select("o_orderpriority", "value")


@register(
    "split_by_own_hash",
    """SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n_rows,
              CAST(count(DISTINCT o_orderkey) AS BIGINT) AS n_keys,
              CAST(floor(count(*) * 0.2::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS n_test,
              CAST(floor(count(*) / 3.0::DOUBLE) AS BIGINT) AS fold_0,
              CAST(floor(count(*) * 2 / 3.0::DOUBLE) - floor(count(*) / 3.0::DOUBLE) AS BIGINT) AS fold_1,
              CAST(count(*) - floor(count(*) * 2 / 3.0::DOUBLE) AS BIGINT) AS fold_2
       FROM orders GROUP BY o_orderstatus""",
)
def _(spark, sf):
    """Sizes of the parts that the plans' own hash makes; every row is in one fold, once."""
    orders = load_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    marked = split.stratified_split(orders, "o_orderkey", "o_orderstatus", 0.2)
    folded = split.k_fold(marked, "o_orderkey", "o_orderstatus", 3, seed=split.SEED + 1)
    return folded.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("o_orderkey").alias("n_keys"),
        F.count_if("is_test").alias("n_test"),
        *[F.count_if(F.col("fold") == i).alias(f"fold_{i}") for i in range(3)],
    )
