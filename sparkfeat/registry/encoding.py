"""Category levels, one-hot columns and alignment of two tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfeat.operators import encode
from sparkfeat.registry.base import ORDERS_WITH_GAPS, orders_with_gaps, register
from sparkfeat.sources.tables import load_table

_STATUS = ["F", "O", "P"]
_PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_EVENTS = ["click", "error", "purchase", "signup", "view"]


def _dummies(column, levels, missing):
    parts = [f"""CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END AS "{column}_{v}\"""" for v in levels]
    if missing:
        parts.append(f"""CASE WHEN {column} IS NULL THEN 1 ELSE 0 END AS "{column}_nan\"""")
    return ", ".join(parts)


def _orders(spark, sf):
    return orders_with_gaps(load_table(spark, sf, "orders")).select("o_orderkey", "status", "priority")


@register(
    "one_hot_null",
    f"""SELECT o_orderkey, {_dummies("status", _STATUS, True)}, {_dummies("priority", _PRIORITY, True)}
        FROM ({ORDERS_WITH_GAPS})""",
)
def _(spark, sf):
    orders = _orders(spark, sf)
    return encode.one_hot(orders, encode.levels(orders))[0]


@register(
    "one_hot_plain",
    f"""SELECT o_orderkey, {_dummies("status", _STATUS, False)}, {_dummies("priority", _PRIORITY, False)}
        FROM ({ORDERS_WITH_GAPS})""",
)
def _(spark, sf):
    orders = _orders(spark, sf)
    return encode.one_hot(orders, encode.levels(orders), null_level=False)[0]


@register(
    "level_catalogue",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c} AS level,
                   CAST(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS ordinal
            FROM (SELECT DISTINCT {c} FROM ({ORDERS_WITH_GAPS}) WHERE {c} IS NOT NULL)"""
        for c in ("status", "priority")
    ),
)
def _(spark, sf):
    return encode.level_catalogue(_orders(spark, sf))


_HALVES = """
SELECT event_id, user_id, CASE WHEN value > 100 THEN 1 ELSE 0 END AS label, day(ts) <= 15 AS is_train,
       CASE WHEN day(ts) <= 15 OR event_type <> 'signup' THEN event_type END AS kind,
       CASE WHEN day(ts) > 15 AND user_id % 2 = 0 THEN 'late' WHEN user_id % 3 = 0 THEN 'third'
            ELSE 'other' END AS team
FROM events
"""
_SHARED = [v for v in _EVENTS if v != "signup"]


@register(
    "align_columns",
    f"""SELECT event_id, user_id, is_train, CASE WHEN is_train THEN label END AS label,
               {_dummies("kind", _SHARED, False)}, {_dummies("team", ["other", "third"], False)}
        FROM ({_HALVES})""",
)
def _(spark, sf):
    """A level that one half lacks is dropped from both; only one half has the label."""
    early = F.dayofmonth("ts") <= 15
    both = load_table(spark, sf, "events").select(
        "event_id",
        "user_id",
        F.when(F.col("value") > 100, 1).otherwise(0).alias("label"),
        early.alias("is_train"),
        F.when(early | (F.col("event_type") != "signup"), F.col("event_type")).alias("kind"),
        F.when(~early & (F.col("user_id") % 2 == 0), "late")
        .when(F.col("user_id") % 3 == 0, "third")
        .otherwise("other")
        .alias("team"),
    )
    train, test = both.where("is_train"), both.where("NOT is_train").drop("label")
    left, right = encode.align(train, test, "label")
    return left.unionByName(right, allowMissingColumns=True)
