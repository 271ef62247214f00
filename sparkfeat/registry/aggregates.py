"""Group aggregation, two-level aggregation, joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfeat.operators import joins
from sparkfeat.operators.aggregate import Subset, aggregate, aggregate_all, rates_long, two_level
from sparkfeat.operators.encode import levels
from sparkfeat.operators.ranking import median
from sparkfeat.registry.base import (
    ORDERS_WITH_GAPS,
    cents,
    lines_with_gaps,
    number_class,
    orders_with_gaps,
    register,
    sql_cents,
    LINES_WITH_GAPS,
)
from sparkfeat.sources.tables import load_table


def rounded(df, scales: dict[str, float]):
    """Variances are not exact sums: compare them after scaling and rounding."""
    return df.withColumns({c: F.round(F.col(c) / F.lit(s), 4) for c, s in scales.items()})


def _gapped_orders(spark, sf):
    return orders_with_gaps(load_table(spark, sf, "orders"))


_PRICE_SPEC = {"price": "min max mean sum var", "day": "min max mean size"}
_PRICE_SQL = """min(price) {w} AS {p}_price_MIN, max(price) {w} AS {p}_price_MAX,
       sum(price) {w} / nullif(count(price) {w}, 0) AS {p}_price_MEAN, {sum} AS {p}_price_SUM,
       round(var_samp(price) {w} / 999983000000.0::DOUBLE, 4) AS {p}_price_VAR,
       min(day) {w} AS {p}_day_MIN, max(day) {w} AS {p}_day_MAX, avg(day) {w} AS {p}_day_MEAN,
       {size} AS {p}_day_SIZE"""


def _price_sql(prefix, where=None):
    if where is None:
        return _PRICE_SQL.format(
            w="", p=prefix, sum="coalesce(sum(price), 0)", size="CAST(count(*) AS BIGINT)"
        )
    w = f"FILTER (WHERE {where})"
    total = f"CASE WHEN count(*) {w} > 0 THEN coalesce(sum(price) {w}, 0) END"
    return _PRICE_SQL.format(w=w, p=prefix, sum=total, size=f"CAST(nullif(count(*) {w}, 0) AS BIGINT)")


@register(
    "agg_spec_orders",
    f"""SELECT client, {_price_sql("ORD")} FROM ({ORDERS_WITH_GAPS})
        WHERE client IS NOT NULL GROUP BY client""",
)
def _(spark, sf):
    out = aggregate(_gapped_orders(spark, sf), "client", _PRICE_SPEC, prefix="ORD")
    return rounded(out, {"ORD_price_VAR": 999983000000.0})


@register(
    "agg_all_null_sum",
    f"""SELECT client, coalesce(sum(price), 0) AS price_SUM, avg(price) AS price_MEAN,
               CAST(count(*) AS BIGINT) AS n_orders
        FROM ({ORDERS_WITH_GAPS}) WHERE client IS NOT NULL GROUP BY client""",
)
def _(spark, sf):
    return aggregate(
        _gapped_orders(spark, sf), "client", {"price": "sum mean"}, count_as="n_orders"
    )


@register(
    "agg_nunique",
    f"""SELECT l_suppkey, CAST(count(DISTINCT quantity) AS BIGINT) AS S_quantity_NUNIQUE,
               coalesce(sum(l_linenumber), 0)::BIGINT AS S_l_linenumber_SUM
        FROM ({LINES_WITH_GAPS}) GROUP BY l_suppkey""",
)
def _(spark, sf):
    return aggregate(
        lines_with_gaps(load_table(spark, sf, "lineitem")),
        "l_suppkey",
        {"quantity": "nunique", "l_linenumber": "sum"},
        prefix="S",
    )


@register(
    "group_median",
    f"""SELECT status, median(price) AS median FROM ({ORDERS_WITH_GAPS})
        WHERE status IS NOT NULL GROUP BY status""",
)
def _(spark, sf):
    return median(_gapped_orders(spark, sf), ["status"], "price")


@register(
    "lookup_median",
    f"""SELECT p_partkey, p_type, median FROM part LEFT JOIN
        (SELECT p_type, median({sql_cents("p_retailprice")}) AS median FROM part
         WHERE p_type <> 'PROMO' GROUP BY p_type) USING (p_type)""",
)
def _(spark, sf):
    """A level without any price looks up nothing."""
    part = load_table(spark, sf, "part").withColumn(
        "price", F.when(F.col("p_type") != "PROMO", cents("p_retailprice"))
    )
    fitted = median(part, ["p_type"], "price")
    return joins.lookup(part.select("p_partkey", "p_type"), fitted, "p_type")


_EVENT_LEVELS = ["click", "error", "purchase", "signup", "view"]


@register(
    "indicator_rates",
    "SELECT user_id, "
    + ", ".join(
        f"avg(CASE WHEN kind = '{v}' THEN 1 ELSE 0 END) AS EV_kind_{v}_MEAN" for v in _EVENT_LEVELS
    )
    + """, avg(CASE WHEN kind IS NULL THEN 1 ELSE 0 END) AS EV_kind_nan_MEAN
       FROM (SELECT user_id, CASE WHEN event_id % 9 <> 0 THEN event_type END AS kind FROM events)
       GROUP BY user_id""",
)
def _(spark, sf):
    events = load_table(spark, sf, "events").select(
        "user_id", F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("kind")
    )
    found = {c: [*v, None] for c, v in levels(events, ["kind"]).items()}
    return aggregate(events, "user_id", {}, prefix="EV", rates=found)


@register(
    "indicator_rates_many",
    "SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n_lines, "
    + ", ".join(
        f"avg(CASE WHEN size = '{q}' THEN 1 ELSE 0 END) AS L_size_{q}_MEAN"
        for q in [f"q{i}" for i in range(1, 51) if i != 13]
    )
    + """, avg(CASE WHEN size IS NULL THEN 1 ELSE 0 END) AS L_size_nan_MEAN
       FROM (SELECT l_suppkey, 'q' || CAST(CAST(quantity AS INTEGER) AS VARCHAR) AS size
             FROM ("""
    + LINES_WITH_GAPS
    + ")) GROUP BY l_suppkey",
)
def _(spark, sf):
    """A column with many levels is counted per key and level, then pivoted."""
    lines = lines_with_gaps(load_table(spark, sf, "lineitem")).select(
        "l_suppkey",
        F.concat(F.lit("q"), F.col("quantity").cast("int").cast("string")).alias("size"),
    )
    found = {c: [*v, None] for c, v in levels(lines, ["size"]).items()}
    return aggregate(lines, "l_suppkey", {}, prefix="L", rates=found, count_as="n_lines")


@register(
    "agg_infinities",
    f"""WITH v AS (SELECT l_orderkey, CASE WHEN l_linenumber = 1 AND l_orderkey % 3 = 0 THEN 'infinity'::DOUBLE
                                           WHEN l_linenumber = 2 AND l_orderkey % 5 = 0 THEN '-infinity'::DOUBLE
                                           WHEN l_linenumber <> 3 THEN l_quantity END AS x FROM lineitem),
            g AS (SELECT l_orderkey, count(x) AS n, count(*) FILTER (WHERE isinf(x) AND x > 0) AS up,
                         count(*) FILTER (WHERE isinf(x) AND x < 0) AS down FROM v GROUP BY l_orderkey)
        SELECT l_orderkey,
               CASE WHEN n = 0 THEN 'missing' WHEN down > 0 THEN '-inf' WHEN up = n THEN '+inf'
                    ELSE 'finite' END AS x_MIN,
               CASE WHEN n = 0 THEN 'missing' WHEN up > 0 THEN '+inf' WHEN down = n THEN '-inf'
                    ELSE 'finite' END AS x_MAX,
               CASE WHEN n = 0 OR (up > 0 AND down > 0) THEN 'missing' WHEN up > 0 THEN '+inf'
                    WHEN down > 0 THEN '-inf' ELSE 'finite' END AS x_MEAN,
               CASE WHEN up > 0 AND down > 0 THEN 'missing' WHEN up > 0 THEN '+inf'
                    WHEN down > 0 THEN '-inf' ELSE 'finite' END AS x_SUM,
               CASE WHEN n < 2 OR up + down > 0 THEN 'missing' ELSE 'finite' END AS x_VAR
        FROM g""",
)
def _(spark, sf):
    """Groups with infinities of one sign, of both, and of none, as the class of each result."""
    number, key = F.col("l_linenumber"), F.col("l_orderkey")
    value = (
        F.when((number == 1) & (key % 3 == 0), F.lit(float("inf")))
        .when((number == 2) & (key % 5 == 0), F.lit(float("-inf")))
        .when(number != 3, F.col("l_quantity"))
    )
    lines = load_table(spark, sf, "lineitem").select("l_orderkey", value.alias("x"))
    out = aggregate(lines, "l_orderkey", {"x": "min max mean sum var"})
    return out.withColumns({c: number_class(F.col(c)) for c in out.columns if c != "l_orderkey"})


_MANY_LEVELS = {"size": [f"q{i}" for i in range(1, 51) if i != 13], "day": [f"d{i}" for i in range(60)]}
_SIZE_AND_DAY = f"""
SELECT l_suppkey, 'q' || CAST(CAST(quantity AS INTEGER) AS VARCHAR) AS size,
       CASE WHEN l_orderkey % 11 <> 0 THEN 'd' || CAST(l_orderkey % 60 AS VARCHAR) END AS day
FROM ({LINES_WITH_GAPS})"""


@register(
    "indicator_rates_two_wide",
    "SELECT l_suppkey, "
    + ", ".join(
        f"avg(CASE WHEN {c} {f"= '{v}'" if v else 'IS NULL'} THEN 1 ELSE 0 END) AS L_{c}_{v or 'nan'}_MEAN"
        for c, known in _MANY_LEVELS.items()
        for v in [*known, None]
    )
    + f" FROM ({_SIZE_AND_DAY}) GROUP BY l_suppkey",
)
def _(spark, sf):
    """Two columns with many levels share one count in long form."""
    lines = lines_with_gaps(load_table(spark, sf, "lineitem")).select(
        "l_suppkey",
        F.concat(F.lit("q"), F.col("quantity").cast("int").cast("string")).alias("size"),
        F.when(
            F.col("l_orderkey") % 11 != 0,
            F.concat(F.lit("d"), (F.col("l_orderkey") % 60).cast("string")),
        ).alias("day"),
    )
    found = {c: [*known, None] for c, known in _MANY_LEVELS.items()}
    return aggregate(lines, "l_suppkey", {}, prefix="L", rates=found)


@register(
    "indicator_rates_long",
    """WITH lines AS (SELECT l_suppkey, CASE WHEN l_partkey % 10 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS part,
                             l_returnflag AS flag FROM lineitem),
            named AS (SELECT l_suppkey, 'part' AS "column", part AS level FROM lines
                      UNION ALL SELECT l_suppkey, 'flag', flag FROM lines)
       SELECT l_suppkey, "column", level, count(*) / n AS rate
       FROM named JOIN (SELECT l_suppkey, count(*) AS n FROM lines GROUP BY 1) USING (l_suppkey)
       GROUP BY l_suppkey, "column", level, n""",
)
def _(spark, sf):
    """Thousands of levels, as rows."""
    lines = load_table(spark, sf, "lineitem").select(
        "l_suppkey",
        F.when(F.col("l_partkey") % 10 != 0, F.col("l_partkey").cast("string")).alias("part"),
        F.col("l_returnflag").alias("flag"),
    )
    return rates_long(lines, "l_suppkey", ["part", "flag"])


_ROLLED = """
SELECT l_orderkey AS o_orderkey, min(l_linenumber) AS l_linenumber_MIN,
       max(l_linenumber) AS l_linenumber_MAX, CAST(count(*) AS BIGINT) AS l_linenumber_SIZE,
       avg(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS l_linestatus_F_MEAN,
       avg(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS l_linestatus_O_MEAN
FROM lineitem GROUP BY l_orderkey
"""


@register(
    "two_level",
    f"""SELECT client, min(l_linenumber_MIN) AS B_l_linenumber_MIN_MIN,
               max(l_linenumber_MAX) AS B_l_linenumber_MAX_MAX,
               coalesce(sum(l_linenumber_SIZE), 0)::BIGINT AS B_l_linenumber_SIZE_SUM,
               avg(l_linenumber_SIZE) AS B_l_linenumber_SIZE_MEAN,
               round(avg(l_linestatus_F_MEAN), 8) AS B_l_linestatus_F_MEAN_MEAN,
               round(avg(l_linestatus_O_MEAN), 8) AS B_l_linestatus_O_MEAN_MEAN
        FROM ({ORDERS_WITH_GAPS}) LEFT JOIN ({_ROLLED}) USING (o_orderkey)
        WHERE client IS NOT NULL GROUP BY client""",
)
def _(spark, sf):
    lines = load_table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    orders, added = two_level(
        lines,
        _gapped_orders(spark, sf),
        "o_orderkey",
        {"l_linenumber": "min max size"},
        levels(lines, ["l_linestatus"]),
    )
    shares = [c for c in added if c.startswith("l_linestatus")]
    spec = {
        "l_linenumber_MIN": "min",
        "l_linenumber_MAX": "max",
        "l_linenumber_SIZE": "mean sum",
        **{c: "mean" for c in shares},
    }
    out = aggregate(orders, "client", spec, prefix="B")
    return out.withColumns({f"B_{c}_MEAN": F.round(f"B_{c}_MEAN", 8) for c in shares})


_SUBSET_SQL = f"""SELECT client, {_price_sql("ALL")}, {_price_sql("F", "status = 'F'")},
                         {_price_sql("O", "status = 'O'")}
                  FROM ({ORDERS_WITH_GAPS}) WHERE client IS NOT NULL GROUP BY client"""


@register("subset_agg", _SUBSET_SQL)
def _(spark, sf):
    out = aggregate(
        _gapped_orders(spark, sf),
        "client",
        _PRICE_SPEC,
        prefix="ALL",
        subsets=[Subset(v, f"status = '{v}'") for v in ("F", "O")],
    )
    return rounded(out, {f"{p}_price_VAR": 999983000000.0 for p in ("ALL", "F", "O")})


@register("subset_agg_joined", _SUBSET_SQL)
def _(spark, sf):
    """The same result from filtered copies that are aggregated and joined."""
    orders = _gapped_orders(spark, sf)
    whole = aggregate(orders, "client", _PRICE_SPEC, prefix="ALL")
    parts = [
        aggregate(orders.where(F.col("status") == v), "client", _PRICE_SPEC, prefix=v)
        for v in ("F", "O")
    ]
    out = joins.assemble(whole, "client", parts)
    return rounded(out, {f"{p}_price_VAR": 999983000000.0 for p in ("ALL", "F", "O")})


_VALUE = sql_cents("value")


@register(
    "all_columns_agg",
    f"""SELECT user_id, min(cents) AS CC_cents_MIN, max(cents) AS CC_cents_MAX,
               avg(cents) AS CC_cents_MEAN, sum(cents) AS CC_cents_SUM,
               round(var_samp(cents) / 999983.0::DOUBLE, 4) AS CC_cents_VAR,
               min(hour) AS CC_hour_MIN, max(hour) AS CC_hour_MAX, avg(hour) AS CC_hour_MEAN,
               CAST(sum(hour) AS BIGINT) AS CC_hour_SUM, round(var_samp(hour) / 0.7::DOUBLE, 4) AS CC_hour_VAR, """
    + ", ".join(
        f"min({e}) AS CC_event_type_{v}_MIN, max({e}) AS CC_event_type_{v}_MAX, "
        f"avg({e}) AS CC_event_type_{v}_MEAN, CAST(sum({e}) AS BIGINT) AS CC_event_type_{v}_SUM, "
        f"round(var_samp({e}) / 0.7::DOUBLE, 4) AS CC_event_type_{v}_VAR"
        for v, e in [
            *[(v, f"CASE WHEN event_type = '{v}' THEN 1 ELSE 0 END") for v in _EVENT_LEVELS],
            ("nan", "CASE WHEN event_type IS NULL THEN 1 ELSE 0 END"),
        ]
    )
    + f""", CAST(count(*) AS BIGINT) AS CC_COUNT
       FROM (SELECT user_id, {_VALUE} AS cents, CAST(hour(ts) AS INTEGER) AS hour, event_type
             FROM events) GROUP BY user_id""",
)
def _(spark, sf):
    events = load_table(spark, sf, "events").select(
        "event_id", "user_id", cents("value").alias("cents"), F.hour("ts").alias("hour"), "event_type"
    )
    found = {c: [*v, None] for c, v in levels(events, ["event_type"]).items()}
    out = aggregate_all(
        events, "user_id", prefix="CC", levels=found, drop=["event_id"], count_as="CC_COUNT"
    )
    small = [c for c in out.columns if c.endswith("_VAR") and c != "CC_cents_VAR"]
    return rounded(out, {"CC_cents_VAR": 999983.0, **{c: 0.7 for c in small}})


@register(
    "approval_rate",
    f"""SELECT o_orderkey, client, status, total_count, approved_count,
               approved_count / total_count AS approval_percent
        FROM ({ORDERS_WITH_GAPS}) LEFT JOIN (
          SELECT client, CAST(count(*) AS BIGINT) AS total_count,
                 CAST(nullif(count(*) FILTER (WHERE status = 'F'), 0) AS BIGINT) AS approved_count
          FROM ({ORDERS_WITH_GAPS}) WHERE client IS NOT NULL GROUP BY client) USING (client)""",
)
def _(spark, sf):
    return joins.with_group_rate(
        _gapped_orders(spark, sf),
        "client",
        F.col("status") == "F",
        total_as="total_count",
        hits_as="approved_count",
        rate_as="approval_percent",
    ).select("o_orderkey", "client", "status", "total_count", "approved_count", "approval_percent")


@register(
    "first_per_key",
    """SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r
         FROM orders) WHERE r = 1""",
)
def _(spark, sf):
    first = joins.first_per_key(load_table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"])
    return first.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("order_date"))


@register(
    "any_per_key",
    """SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_orders FROM orders GROUP BY o_custkey""",
)
def _(spark, sf):
    """Rows that repeat their key's count, reduced to one row per key."""
    rows = joins.with_group_rate(
        load_table(spark, sf, "orders"),
        "o_custkey",
        F.col("o_orderstatus") == "F",
        total_as="n_orders",
        hits_as="n_final",
        rate_as="rate",
    )
    return joins.any_per_key(rows.select("o_custkey", "n_orders"), "o_custkey")


@register(
    "join_shared",
    """SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, n FROM orders o LEFT JOIN
       (SELECT o_custkey, o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders
        WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey, o_orderstatus) c
       ON o.o_custkey = c.o_custkey AND o.o_orderstatus = c.o_orderstatus""",
)
def _(spark, sf):
    """Left join on every column name that both sides have."""
    orders = load_table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"
    )
    counts = (
        orders.where("o_orderpriority = '1-URGENT'")
        .groupBy("o_custkey", "o_orderstatus")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return joins.join_shared(orders.drop("o_orderpriority"), counts)


@register(
    "assemble",
    f"""SELECT c_custkey, c_mktsegment, price_SUM, price_MEAN, n_orders, EVT_cents_SUM, EVT_cents_MAX,
               URG_day_MAX
        FROM customer
        LEFT JOIN (SELECT client AS c_custkey, coalesce(sum(price), 0) AS price_SUM,
                          avg(price) AS price_MEAN, CAST(count(*) AS BIGINT) AS n_orders
                   FROM ({ORDERS_WITH_GAPS}) WHERE client IS NOT NULL GROUP BY client) USING (c_custkey)
        LEFT JOIN (SELECT user_id AS c_custkey, sum({_VALUE}) AS EVT_cents_SUM,
                          max({_VALUE}) AS EVT_cents_MAX FROM events GROUP BY user_id) USING (c_custkey)
        LEFT JOIN (SELECT client AS c_custkey, max(day) AS URG_day_MAX FROM ({ORDERS_WITH_GAPS})
                   WHERE client IS NOT NULL AND priority = '1-URGENT' GROUP BY client)
             USING (c_custkey)""",
)
def _(spark, sf):
    orders = _gapped_orders(spark, sf).withColumnRenamed("client", "c_custkey")
    events = load_table(spark, sf, "events").select(
        F.col("user_id").alias("c_custkey"), cents("value").alias("cents")
    )
    return joins.assemble(
        load_table(spark, sf, "customer").select("c_custkey", "c_mktsegment"),
        "c_custkey",
        [
            aggregate(orders, "c_custkey", {"price": "sum mean"}, count_as="n_orders"),
            aggregate(events, "c_custkey", {"cents": "sum max"}, prefix="EVT"),
            aggregate(
                orders.where(F.col("priority") == "1-URGENT"), "c_custkey", {"day": "max"}, prefix="URG"
            ),
        ],
    )
