"""Row-wise statistics, fitted transforms, bins and polynomials."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from sparkfeat.functions import row_mean, row_sum, with_row_stats
from sparkfeat.operators import expand, fitted
from sparkfeat.registry.base import (
    LINE_KEYS,
    LINES_WITH_GAPS,
    ORDERS_WITH_GAPS,
    cents,
    lines_with_gaps,
    register,
    sql_cents,
)
from sparkfeat.sources.tables import load_table

_KEYS = ", ".join(LINE_KEYS)
_THREE = ["quantity", "discount", "tax"]


def _sql_stats(columns):
    """Mean, second and fourth moment and count of a row's present values, in SQL."""
    n = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in columns)
    total = " + ".join(f"coalesce({c}, 0)" for c in columns)
    return f"({n})", f"({total})"


_N, _TOTAL = _sql_stats(_THREE)
_LINE_STATS = f"""
SELECT *, CASE WHEN n > 0 THEN total / n END AS mean
FROM (SELECT *, {_N} AS n, {_TOTAL} AS total FROM ({LINES_WITH_GAPS}))
"""


def _lines(spark, sf):
    return lines_with_gaps(load_table(spark, sf, "lineitem"))


@register("row_sum", f"SELECT {_KEYS}, round(total, 6) AS total FROM ({_LINE_STATS})")
def _(spark, sf):
    return _lines(spark, sf).select(*LINE_KEYS, F.round(row_sum(_THREE), 6).alias("total"))


@register("row_mean", f"SELECT {_KEYS}, round(mean, 6) AS mean FROM ({_LINE_STATS})")
def _(spark, sf):
    return _lines(spark, sf).select(*LINE_KEYS, F.round(row_mean(_THREE), 6).alias("mean"))


_SQUARES = " + ".join(f"coalesce(({c} - mean) * ({c} - mean), 0)" for c in _THREE)


@register(
    "row_std",
    f"""SELECT {_KEYS}, round(CASE WHEN n >= 2 THEN sqrt(({_SQUARES}) / (n - 1)) END, 6) AS std
        FROM ({_LINE_STATS})""",
)
def _(spark, sf):
    out = with_row_stats(_lines(spark, sf), _THREE, std="std")
    return out.select(*LINE_KEYS, F.round("std", 6).alias("std"))


_FLAGS = {
    "f_urgent": "o_orderpriority = '1-URGENT'",
    "f_high": "o_orderpriority = '2-HIGH'",
    "f_final": "o_orderstatus = 'F'",
    "f_open": "o_orderstatus = 'O'",
    "f_even": "o_custkey % 2 = 0",
}
_KURT_N, _KURT_TOTAL = _sql_stats([*_FLAGS, "f_gap"])
_KURT_MOMENTS = [
    " + ".join(f"coalesce(power({c} - mean, {p}), 0)" for c in [*_FLAGS, "f_gap"]) for p in (2, 4)
]


@register(
    "row_kurtosis",
    f"""SELECT o_orderkey, round(CASE WHEN n >= 4 THEN CASE WHEN m2 < 1e-14 THEN 0
                 ELSE n * (n + 1.0) * (n - 1) * m4 / ((n - 2.0) * (n - 3) * m2 * m2)
                      - 3 * (n - 1.0) * (n - 1) / ((n - 2.0) * (n - 3)) END END, 6) AS kurtosis,
               round(kurt_prices, 5) AS kurt_prices
        FROM (SELECT *, {_KURT_MOMENTS[0]} AS m2, {_KURT_MOMENTS[1]} AS m4 FROM
               (SELECT *, {_KURT_TOTAL}::DOUBLE / n AS mean FROM
                 (SELECT *, ({_KURT_N})::DOUBLE AS n FROM
                   (SELECT o_orderkey, {", ".join(f"CASE WHEN {w} THEN 1 ELSE 0 END AS {c}" for c, w in _FLAGS.items())},
                           CASE WHEN o_orderkey % 3 <> 0 THEN 0 END AS f_gap,
                           (SELECT kurtosis(v) FROM unnest([o_totalprice, o_custkey, o_orderkey % 1000,
                                   100.0, 7.0 * (o_custkey % 13)]) AS u(v)) AS kurt_prices
                    FROM orders))))""",
)
def _(spark, sf):
    orders = load_table(spark, sf, "orders")
    flags = {c: F.expr(f"CASE WHEN {w} THEN 1 ELSE 0 END") for c, w in _FLAGS.items()}
    flags["f_gap"] = F.when(F.col("o_orderkey") % 3 != 0, F.lit(0))
    mixed = {
        "v1": F.col("o_totalprice"),
        "v2": F.col("o_custkey"),
        "v3": F.col("o_orderkey") % 1000,
        "v4": F.lit(100.0),
        "v5": F.lit(7.0) * (F.col("o_custkey") % 13),
    }
    out = with_row_stats(orders.withColumns({**flags, **mixed}), list(flags), kurtosis="kurtosis")
    out = with_row_stats(out, list(mixed), kurtosis="kurt_prices")
    return out.select(
        "o_orderkey", F.round("kurtosis", 6).alias("kurtosis"), F.round("kurt_prices", 5).alias("kurt_prices")
    )


def _clip_sql(trigger):
    return f"""
    SELECT event_id, round(CASE WHEN value - m > {trigger} * s THEN m + 3 * s
                                WHEN m - value > {trigger} * s THEN m - 3 * s ELSE value END, 6) AS value,
           value - m > {trigger} * s OR m - value > {trigger} * s AS is_clipped
    FROM (SELECT *, avg(value) OVER () AS m, stddev_samp(value) OVER () AS s FROM
          (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN value END AS value FROM events))"""


def _clip(trigger):
    def run(spark, sf):
        events = load_table(spark, sf, "events").select(
            "event_id", F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value")
        )
        stats = fitted.fit_mean_std(events, ["value"])
        out = fitted.apply_sigma_clip(
            events.withColumn("before", F.col("value")), stats, trigger=trigger, clamp=3.0
        )
        changed = F.col("value") != F.col("before")
        return out.select("event_id", F.round("value", 6).alias("value"), changed.alias("is_clipped"))

    return run


register("sigma_clip_3", _clip_sql("3.0::DOUBLE"))(_clip(3.0))
register("sigma_clip_35", _clip_sql("3.5::DOUBLE"))(_clip(3.5))


_RANGES = " UNION ALL ".join(
    f"SELECT {i} AS place, '{c}' AS name, min({c}) AS low, max({c}) AS high FROM lineitem"
    for i, c in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
)


@register(
    "clip_columns",
    f"""SELECT CAST(count(*) AS BIGINT) AS row_count, coalesce(
               (SELECT string_agg(name, ',' ORDER BY place) FROM ({_RANGES})
                WHERE NOT (low > -65504 AND high < 65504)
                  AND low > -3.4028234663852886e38 AND high < 3.4028234663852886e38), '') AS clipped
        FROM lineitem""",
)
def _(spark, sf):
    """Only float columns with a range beyond 16 bits are clipped; keys and small floats stay."""
    lines = load_table(spark, sf, "lineitem").withColumn(
        "SK_ID_LINE", F.col("l_extendedprice") * F.lit(10.0)
    )
    names = fitted.fit_sigma_clip(lines)
    return lines.agg(F.count(F.lit(1)).alias("row_count")).withColumn("clipped", F.lit(",".join(names)))


@register(
    "mean_fill",
    f"""SELECT {_KEYS}, round(coalesce(std, avg(std) OVER ()), 6) AS std FROM (
          SELECT {_KEYS}, CASE WHEN n >= 2 THEN sqrt(({_SQUARES}) / (n - 1)) END AS std
          FROM ({_LINE_STATS}))""",
)
def _(spark, sf):
    out = with_row_stats(_lines(spark, sf), _THREE, std="std")
    out = fitted.apply_fill(out, fitted.fit_mean(out, ["std"]))
    return out.select(*LINE_KEYS, F.round("std", 6).alias("std"))


@register(
    "median_impute",
    f"WITH gaps AS ({LINES_WITH_GAPS}) SELECT {_KEYS}, "
    + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM gaps)) AS {c}" for c in _THREE)
    + " FROM gaps",
)
def _(spark, sf):
    lines = _lines(spark, sf)
    return fitted.apply_fill(lines, fitted.fit_median(lines, _THREE))


_POLY = {"a": "l_quantity / 50", "b": "l_discount * 10", "c": "l_tax * 10", "d": "l_linenumber / 7.0::DOUBLE"}


def _poly_sql():
    terms = []
    for size in (2, 3):
        for factors in combinations_with_replacement(_POLY, size):
            name = " ".join(
                c if factors.count(c) == 1 else f"{c}^{factors.count(c)}" for c in dict.fromkeys(factors)
            )
            terms.append(f'{" * ".join(factors)} AS "{name}"')
    values = ", ".join(f"{e} AS {c}" for c, e in _POLY.items())
    return f"SELECT {_KEYS}, {', '.join(terms)} FROM (SELECT {_KEYS}, {values} FROM lineitem)"


@register("poly3", _poly_sql())
def _(spark, sf):
    lines = load_table(spark, sf, "lineitem").select(
        *LINE_KEYS,
        (F.col("l_quantity") / 50).alias("a"),
        (F.col("l_discount") * 10).alias("b"),
        (F.col("l_tax") * 10).alias("c"),
        (F.col("l_linenumber") / F.lit(7.0)).alias("d"),
    )
    out = expand.with_polynomials(lines, list(_POLY), 3)
    terms = [c for c in out.columns if c not in LINE_KEYS and c not in _POLY]
    return out.select(*LINE_KEYS, *[F.col(f"`{c}`") for c in terms])


@register(
    "age_bins",
    """SELECT p_partkey, CASE WHEN p_size > 5 AND p_size <= 45 THEN
                CAST(ceil((p_size - 5) / 4.0) AS INTEGER) END AS bin,
              CASE WHEN p_size > 5 AND p_size <= 45 THEN
                format('({:.1f}, {:.1f}]', 5 + 4.0 * (ceil((p_size - 5) / 4.0) - 1),
                       5 + 4.0 * ceil((p_size - 5) / 4.0)) END AS bin_label FROM part""",
)
def _(spark, sf):
    number = expand.equal_width_bin("p_size", 5.0, 45.0, 10)
    return load_table(spark, sf, "part").select(
        "p_partkey",
        number.alias("bin"),
        expand.bin_label(number, expand.bin_labels(5.0, 45.0, 10)).alias("bin_label"),
    )


_SCALED = f"""
SELECT o_orderkey, status, {sql_cents("o_totalprice")} AS price, 5.0::DOUBLE AS fixed,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'infinity'::DOUBLE
            ELSE CAST(o_custkey AS DOUBLE) END AS gaps
FROM orders JOIN ({ORDERS_WITH_GAPS}) USING (o_orderkey)
"""


def _min_max_sql(c):
    zero = f"CASE WHEN isfinite({c}) THEN {c} ELSE 0 END"
    fit = f"(SELECT {{f}}({zero}) FROM scaled WHERE status = 'F')"
    low, high = fit.format(f="min"), fit.format(f="max")
    return f"({zero} - {low}) / CASE WHEN {high} = {low} THEN 1 ELSE {high} - {low} END AS {c}"


@register(
    "minmax_fit_apply",
    f"""WITH scaled AS ({_SCALED}) SELECT o_orderkey, status, {_min_max_sql("price")},
        {_min_max_sql("fixed")}, {_min_max_sql("gaps")} FROM scaled""",
)
def _(spark, sf):
    """Fitted on one status, applied to all rows; a constant column and one with gaps."""
    orders = load_table(spark, sf, "orders")
    table = orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("status"),
        cents("o_totalprice").alias("price"),
        F.lit(5.0).alias("fixed"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(None))
        .when(F.col("o_orderkey") % 11 == 0, F.lit(float("inf")))
        .otherwise(F.col("o_custkey").cast("double"))
        .alias("gaps"),
    )
    stats = fitted.fit_min_max(table.where("status = 'F'"))
    return fitted.apply_min_max(table, fitted.read_stats(fitted.stats_table(spark, stats)))
