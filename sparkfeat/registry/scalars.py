"""Sources and sinks, projections, column selection and filters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfeat.functions import (
    ieee_div,
    missing_interaction,
    offset_ratio,
    positive_part,
    row_product,
    sentinel_to_null,
)
from sparkfeat.operators import columns as C
from sparkfeat.operators import filters, profile
from sparkfeat.operators.joins import assemble
from sparkfeat.operators.split import hash_split
from sparkfeat.registry.base import (
    LINE_KEYS,
    LINES_WITH_GAPS,
    ORDERS_WITH_GAPS,
    inside,
    lines_with_gaps,
    number_class,
    orders_with_gaps,
    register,
    sql_class,
    sql_finite,
    sql_ratio,
)
from sparkfeat.sources.store import scratch_path
from sparkfeat.sources.tables import (
    blank_na_tokens,
    load_table,
    read_csv,
    write_features,
    write_scores,
)

_PROFILED = {
    "l_orderkey": True, "l_partkey": True, "l_suppkey": True, "l_linenumber": True,
    "l_quantity": False, "l_extendedprice": False, "l_discount": False, "l_tax": False,
}
_INTEGER_CLASS = (
    "CASE WHEN {lo} > -128 AND {hi} < 127 THEN 'int8' WHEN {lo} > -32768 AND {hi} < 32767 "
    "THEN 'int16' WHEN {lo} > -2147483648 AND {hi} < 2147483647 THEN 'int32' ELSE 'int64' END"
)
_FLOAT_CLASS = (
    "CASE WHEN {lo} > -65504 AND {hi} < 65504 THEN 'float16' "
    "WHEN {lo} > -3.4028234663852886e38 AND {hi} < 3.4028234663852886e38 THEN 'float32' "
    "ELSE 'float64' END"
)


def _profile_sql(c, integer):
    lo, hi = f"min({c})", f"max({c})"
    kind = (_INTEGER_CLASS if integer else _FLOAT_CLASS).format(lo=lo, hi=hi)
    return (
        f"SELECT '{c}' AS column_name, CAST({lo} AS DOUBLE) AS min_value, "
        f"CAST({hi} AS DOUBLE) AS max_value, {kind} AS type_class FROM lineitem"
    )


@register("range_profile", " UNION ALL ".join(_profile_sql(c, i) for c, i in _PROFILED.items()))
def _(spark, sf):
    return profile.range_profile(load_table(spark, sf, "lineitem"))


_NARROW = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint"}


def _narrow_sql(c):
    kind = _INTEGER_CLASS.format(lo=f"min({c})", hi=f"max({c})")
    named = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NARROW.items())
    return (
        f"SELECT '{c}' AS column_name, CASE {kind} {named} END AS narrow_type, "
        f"CAST(sum({c}) AS BIGINT) AS total FROM lineitem"
    )


@register(
    "narrow_types", " UNION ALL ".join(_narrow_sql(c) for c, i in _PROFILED.items() if i)
)
def _(spark, sf):
    lines = load_table(spark, sf, "lineitem")
    found = profile.narrow(lines.select(*profile.integer_columns(lines)))
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    totals = found.agg(*[F.sum(F.col(c).cast("bigint")).alias(c) for c in kinds])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(k).alias("narrow_type"), F.col(c).alias("total")
        )
        for c, k in kinds.items()
    ]
    return totals.select(F.inline(F.array(*rows)))


_TOKEN_RULE = [(2, ""), (3, "NA"), (5, "#N/A"), (7, "null"), (11, "XNA")]
_TOKENS_SQL = (
    "CASE "
    + " ".join(f"WHEN p_partkey % {m} = 1 THEN '{v}'" for m, v in _TOKEN_RULE)
    + " ELSE p_type END"
)


def _tokens():
    marked = F.col("p_type")
    for modulus, text in reversed(_TOKEN_RULE):
        marked = F.when(F.col("p_partkey") % modulus == 1, F.lit(text)).otherwise(marked)
    return marked


@register(
    "na_tokens",
    f"""SELECT p_partkey, CASE WHEN kind NOT IN ('', 'NA', '#N/A', 'null') THEN kind END AS kind
        FROM (SELECT p_partkey, {_TOKENS_SQL} AS kind FROM part)""",
)
def _(spark, sf):
    marked = load_table(spark, sf, "part").select("p_partkey", _tokens().alias("kind"))
    return blank_na_tokens(marked)


@register(
    "csv_scan",
    f"""SELECT o_orderkey, CAST(client AS DOUBLE) AS client, status, price,
               CAST(day AS BIGINT) AS day, priority FROM ({ORDERS_WITH_GAPS})""",
)
def _(spark, sf):
    """Orders written as CSV with missing-value tokens, read back with inferred types."""
    path = scratch_path(spark, "orders-csv")
    orders = orders_with_gaps(load_table(spark, sf, "orders"))
    orders.write.option("header", True).option("nullValue", "NA").csv(path)
    return read_csv(spark, path, {"price": "double"})


@register(
    "score_sink",
    """SELECT c_custkey AS "SK_ID_CURR", (c_acctbal + 1000) / 16000 AS "TARGET" FROM customer""",
)
def _(spark, sf):
    path = scratch_path(spark, "scores")
    scores = load_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("SK_ID_CURR"),
        ((F.col("c_acctbal") + 1000) / 16000).alias("TARGET"),
    )
    write_scores(scores, path)
    return read_csv(spark, path, {"SK_ID_CURR": "bigint", "TARGET": "double"})


@register(
    "feature_export",
    """SELECT c_custkey, c_mktsegment, CAST(count(o_orderkey) AS BIGINT) AS n_orders
       FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment""",
)
def _(spark, sf):
    path = scratch_path(spark, "features")
    counts = load_table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders")
    )
    customers = load_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    wide = C.fill_final(assemble(customers, "c_custkey", [counts]))
    write_features(wide, path, partition_by="c_mktsegment")
    return spark.read.parquet(path).select("c_custkey", "c_mktsegment", "n_orders")


@register(
    "row_guard",
    """SELECT CAST(count(*) AS BIGINT) AS row_count,
              (SELECT CAST(count(*) AS INTEGER) FROM (
                 DESCRIBE SELECT customer.*, n_orders, largest_order FROM customer LEFT JOIN (
                   SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS largest_order
                   FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey)) AS column_count
       FROM customer""",
)
def _(spark, sf):
    customers = load_table(spark, sf, "customer")
    per_client = load_table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("largest_order")
    )
    joined = assemble(customers, "c_custkey", [per_client])
    profile.check_same_rows(customers, joined)
    return joined.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "column_count", F.lit(len(joined.columns))
    )


_KEYS = ", ".join(LINE_KEYS)
_TAX_RATIO = sql_ratio("l_tax", "l_discount")


@register(
    "ieee_ratio",
    f"""SELECT {_KEYS}, {sql_finite("ratio")} AS ratio, {sql_class("ratio")} AS ratio_class,
               {sql_finite("negative")} AS negative, {sql_class("negative")} AS negative_class,
               one_plus
        FROM (SELECT {_KEYS}, {_TAX_RATIO} AS ratio,
                     {sql_ratio("-l_quantity", "l_discount")} AS negative,
                     l_extendedprice / (1 + l_quantity) AS one_plus FROM lineitem)""",
)
def _(spark, sf):
    lines = load_table(spark, sf, "lineitem")
    ratios = lines.select(
        *LINE_KEYS,
        ieee_div("l_tax", "l_discount").alias("ratio"),
        ieee_div(-F.col("l_quantity"), "l_discount").alias("negative"),
        ieee_div("l_extendedprice", F.lit(1) + F.col("l_quantity")).alias("one_plus"),
    )
    return ratios.select(
        *LINE_KEYS,
        inside(F.col("ratio")).alias("ratio"),
        number_class(F.col("ratio")).alias("ratio_class"),
        inside(F.col("negative")).alias("negative"),
        number_class(F.col("negative")).alias("negative_class"),
        "one_plus",
    )


@register(
    "diff_clamp",
    f"""SELECT {_KEYS}, late, CASE WHEN late > 0 THEN late ELSE 0 END AS days_late,
               CASE WHEN -late > 0 THEN -late ELSE 0 END AS days_early
        FROM (SELECT {_KEYS}, CASE WHEN l_quantity <> 13 THEN CAST(date_diff('day',
                     DATE '1998-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) END AS late
              FROM lineitem)""",
)
def _(spark, sf):
    lines = load_table(spark, sf, "lineitem")
    late = F.when(F.col("l_quantity") != 13, F.datediff("l_shipdate", F.lit("1998-01-01")))
    return lines.select(
        *LINE_KEYS,
        late.alias("late"),
        positive_part(late).alias("days_late"),
        positive_part(-late).alias("days_early"),
    )


_SENTINEL = "CASE WHEN p_partkey % {m} = 0 THEN 365243 ELSE p_size END"


@register(
    "sentinel_null",
    f"SELECT p_partkey, nullif({_SENTINEL.format(m=11)}, 365243) AS days FROM part",
)
def _(spark, sf):
    marked = F.when(F.col("p_partkey") % 11 == 0, 365243).otherwise(F.col("p_size"))
    return load_table(spark, sf, "part").select(
        "p_partkey", sentinel_to_null(marked, 365243).alias("days")
    )


@register(
    "sentinels_null",
    "SELECT p_partkey, "
    + ", ".join(f"nullif({_SENTINEL.format(m=m)}, 365243) AS days_{m}" for m in (2, 3, 5, 7, 11))
    + " FROM part",
)
def _(spark, sf):
    days = {
        f"days_{m}": F.when(F.col("p_partkey") % m == 0, 365243).otherwise(F.col("p_size"))
        for m in (2, 3, 5, 7, 11)
    }
    marked = load_table(spark, sf, "part").withColumns(days).select("p_partkey", *days)
    return C.sentinels_to_null(marked, days, 365243)


_PAIRS = [(a, b) for a in ("quantity", "discount", "tax") for b in ("quantity", "discount", "tax") if a != b]


def _offset(c):
    return f"(coalesce({c}, -1.0::DOUBLE) + 0.1::DOUBLE)"


@register(
    "offset_ratios",
    f"SELECT {_KEYS}, "
    + ", ".join(f"{sql_ratio(_offset(a), _offset(b))} AS {a}_over_{b}" for a, b in _PAIRS)
    + f" FROM ({LINES_WITH_GAPS})",
)
def _(spark, sf):
    lines = lines_with_gaps(load_table(spark, sf, "lineitem"))
    return lines.select(
        *LINE_KEYS, *[offset_ratio(a, b).alias(f"{a}_over_{b}") for a, b in _PAIRS]
    )


@register(
    "null_interactions",
    f"SELECT {_KEYS}, "
    + ", ".join(
        f"CASE WHEN {a} IS NULL THEN coalesce({b}, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS {b}_without_{a}"
        for a, b in _PAIRS
    )
    + f" FROM ({LINES_WITH_GAPS})",
)
def _(spark, sf):
    lines = lines_with_gaps(load_table(spark, sf, "lineitem"))
    return lines.select(
        *LINE_KEYS, *[missing_interaction(a, b).alias(f"{b}_without_{a}") for a, b in _PAIRS]
    )


@register("abs_unit_change", "SELECT c_custkey, abs(c_acctbal) / 365 AS per_day FROM customer")
def _(spark, sf):
    return load_table(spark, sf, "customer").select(
        "c_custkey", (F.abs("c_acctbal") / F.lit(365)).alias("per_day")
    )


@register(
    "row_product",
    f"SELECT {_KEYS}, quantity * discount * tax AS product FROM ({LINES_WITH_GAPS})",
)
def _(spark, sf):
    lines = lines_with_gaps(load_table(spark, sf, "lineitem"))
    return lines.select(*LINE_KEYS, row_product(["quantity", "discount", "tax"]).alias("product"))


_GAP_RATIO = sql_ratio("tax", "discount")


@register(
    "final_fill",
    f"""SELECT {_KEYS}, CASE WHEN isfinite(ratio) THEN ratio ELSE 0 END AS ratio,
               coalesce(quantity, 0) AS quantity
        FROM (SELECT *, {_GAP_RATIO} AS ratio FROM ({LINES_WITH_GAPS}))""",
)
def _(spark, sf):
    lines = lines_with_gaps(load_table(spark, sf, "lineitem"))
    return C.fill_final(
        lines.select(*LINE_KEYS, "quantity", ieee_div("tax", "discount").alias("ratio"))
    )


@register(
    "fill_steps",
    f"""SELECT {_KEYS}, {sql_class("CASE WHEN isinf(ratio) THEN 0 ELSE ratio END")} AS after_infinite,
               CASE WHEN isfinite(ratio) THEN ratio ELSE 0 END AS ratio
        FROM (SELECT *, {_GAP_RATIO} AS ratio FROM ({LINES_WITH_GAPS}))""",
)
def _(spark, sf):
    lines = lines_with_gaps(load_table(spark, sf, "lineitem"))
    finite = C.infinite_to_zero(lines.select(*LINE_KEYS, ieee_div("tax", "discount").alias("ratio")))
    return C.missing_to_zero(finite.withColumn("after_infinite", number_class(F.col("ratio"))))


@register(
    "drop_lenient",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders",
)
def _(spark, sf):
    unwanted = ["o_totalprice", "o_orderpriority", "never_created", "NEW_RATIO_PRICE"]
    return C.drop_lenient(load_table(spark, sf, "orders"), unwanted)


@register(
    "drop_strict",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders",
)
def _(spark, sf):
    return C.drop_strict(load_table(spark, sf, "orders"), "o_orderpriority")


@register(
    "select_by_pattern",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_discount, l_tax FROM lineitem",
)
def _(spark, sf):
    lines = load_table(spark, sf, "lineitem")
    keys = C.names_containing(lines, "key")
    amounts = C.names_containing(lines, "t", without=["quantity", "price", "status", "date", "return", "part"])
    return lines.select(*keys, *amounts)


@register(
    "select_by_type",
    "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem",
)
def _(spark, sf):
    lines = load_table(spark, sf, "lineitem")
    return lines.select(*C.names_of_type(lines, T.DoubleType, T.StringType))


@register(
    "new_columns",
    """SELECT 'ratio' AS new_column, CAST(count(l_tax) AS BIGINT) AS row_count FROM lineitem
       UNION ALL SELECT 'days', CAST(count(l_shipdate) AS BIGINT) FROM lineitem""",
)
def _(spark, sf):
    def derive(df):
        return df.withColumns(
            {"ratio": F.col("l_tax") / F.lit(2), "days": F.datediff("l_shipdate", F.lit("1998-01-01"))}
        )

    out, added = C.with_new_columns(load_table(spark, sf, "lineitem"), derive)
    counts = out.agg(*[F.count(c).alias(c) for c in added])
    rows = [F.struct(F.lit(c).alias("new_column"), F.col(c).alias("row_count")) for c in added]
    return counts.select(F.inline(F.array(*rows)))


@register(
    "feature_label_split",
    """SELECT c_custkey, c_nationkey + c_acctbal AS feature_total,
              CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS label FROM customer""",
)
def _(spark, sf):
    table = load_table(spark, sf, "customer").select(
        "c_custkey",
        "c_nationkey",
        "c_acctbal",
        F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("label"),
    )
    names, label = C.split_label(table, "label", "c_custkey")
    total = F.col(names[0])
    for n in names[1:]:
        total = total + F.col(n)
    return table.select("c_custkey", total.alias("feature_total"), label)


@register(
    "filter_ne_keep_null",
    f"SELECT o_orderkey, status, price FROM ({ORDERS_WITH_GAPS}) WHERE status IS DISTINCT FROM 'P'",
)
def _(spark, sf):
    orders = orders_with_gaps(load_table(spark, sf, "orders"))
    return filters.keep_different(orders, "status", "P").select("o_orderkey", "status", "price")


@register(
    "filter_lt",
    f"SELECT o_orderkey, price FROM ({ORDERS_WITH_GAPS}) WHERE price < 30000000",
)
def _(spark, sf):
    orders = orders_with_gaps(load_table(spark, sf, "orders"))
    return filters.keep_below(orders, "price", 30_000_000).select("o_orderkey", "price")


@register(
    "filter_category",
    f"SELECT o_orderkey, status FROM ({ORDERS_WITH_GAPS}) WHERE status = 'F'",
)
def _(spark, sf):
    orders = orders_with_gaps(load_table(spark, sf, "orders"))
    return filters.keep_category(orders, "status", "F").select("o_orderkey", "status")


@register(
    "train_only_clean",
    f"""WITH marked AS (
          SELECT *, ('0x' || substr(md5('314:' || o_orderkey), 1, 13))::BIGINT
                    < CAST(round(0.8 * 4503599627370496) AS BIGINT) AS is_train
          FROM ({ORDERS_WITH_GAPS}))
        SELECT o_orderkey, status, price, is_train FROM marked
        WHERE NOT is_train OR (status IS DISTINCT FROM 'P' AND price < 30000000)""",
)
def _(spark, sf):
    orders = orders_with_gaps(load_table(spark, sf, "orders"))
    marked = hash_split(orders, "o_orderkey", 0.8, into="is_train", portable=True)
    train = filters.clean_training_rows(
        marked.where("is_train"), {"status": "P"}, {"price": 30_000_000}
    )
    both = train.unionByName(marked.where("NOT is_train"))
    return both.select("o_orderkey", "status", "price", "is_train")
