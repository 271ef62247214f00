"""The composite feature plans, run on tables that play the roles of the loan history.

Orders stand for external credits and earlier applications, line items for months and
instalments, events for card and point-of-sale months, customers for applications.
"""

from __future__ import annotations

import re
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.operators import model as M
from sparkfeat.operators.expand import bin_labels
from sparkfeat.operators.split import hash_split
from sparkfeat.plans import application, history, scoring
from sparkfeat.registry.base import inside, kept, number_class, register, sql_class, sql_finite, sql_ratio
from sparkfeat.sources.store import materialize
from sparkfeat.sources.tables import load_table

_CLIENT = "CASE WHEN o_custkey % 97 <> 0 THEN o_custkey END"
_CENTS = "round(o_totalprice * 100)"
_DAY = {
    "spark": "datediff({c}, DATE '1995-01-01')",
    "sql": "CAST(date_diff('day', DATE '1995-01-01', CAST({c} AS DATE)) AS INTEGER)",
}

# Role tables: expressions that both engines read alike; {day} is days since 1995.
BUREAU = ("orders", "o_orderdate", {
    "SK_ID_CURR": _CLIENT,
    "SK_ID_BUREAU": "o_orderkey",
    "CREDIT_ACTIVE": "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Active' "
                     "WHEN o_orderstatus = 'O' THEN 'Closed' ELSE 'Bad debt' END",
    "CREDIT_TYPE": "o_orderpriority",
    "DAYS_CREDIT": "{day}",
    "DAYS_CREDIT_ENDDATE": "CASE WHEN o_orderkey % 5 <> 0 THEN CAST({day} + o_orderkey % 400 AS DOUBLE) END",
    "DAYS_CREDIT_UPDATE": "{day} - 3",
    "CREDIT_DAY_OVERDUE": "CAST(o_orderkey % 30 AS INTEGER)",
    "AMT_CREDIT_MAX_OVERDUE": f"CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 100 = 1 "
                              f"THEN {_CENTS} * 40 ELSE {_CENTS} END",
    "AMT_CREDIT_SUM": f"CASE WHEN o_custkey % 50 <> 0 THEN {_CENTS} END",
    "AMT_CREDIT_SUM_DEBT": f"CASE WHEN o_orderkey % 4 <> 0 THEN {_CENTS} - 1000 END",
    "AMT_CREDIT_SUM_OVERDUE": "CAST(o_custkey AS DOUBLE)",
    "AMT_CREDIT_SUM_LIMIT": f"CASE WHEN o_orderkey % 5 = 0 THEN {_CENTS} END",
    "AMT_ANNUITY": f"CASE WHEN o_orderkey % 2 = 0 THEN {_CENTS} END",
    "CNT_CREDIT_PROLONG": "CAST(o_orderkey % 3 AS INTEGER)",
})
BALANCE = ("lineitem", "l_shipdate", {
    "SK_ID_BUREAU": "l_orderkey",
    "MONTHS_BALANCE": "-l_linenumber",
    "STATUS": "CASE WHEN l_quantity <> 13 THEN l_linestatus END",
})
PREVIOUS = ("orders", "o_orderdate", {
    "SK_ID_PREV": "o_orderkey",
    "SK_ID_CURR": _CLIENT,
    "NAME_CONTRACT_STATUS": "CASE WHEN o_orderstatus = 'F' THEN 'Approved' WHEN o_orderstatus = 'O' "
                            "THEN 'Refused' ELSE 'Unused offer' END",
    "NAME_CONTRACT_TYPE": "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END",
    "AMT_ANNUITY": f"CASE WHEN o_orderkey % 2 = 0 THEN {_CENTS} END",
    "AMT_APPLICATION": f"CASE WHEN o_orderkey % 26 = 0 THEN 0e0 ELSE {_CENTS} END",
    "AMT_CREDIT": f"CASE WHEN o_orderkey % 13 = 0 THEN 0e0 ELSE {_CENTS} + 5000 END",
    "AMT_DOWN_PAYMENT": f"CASE WHEN o_orderkey % 3 = 0 THEN {_CENTS} END",
    "AMT_GOODS_PRICE": f"CASE WHEN o_custkey % 50 <> 0 THEN {_CENTS} + 7 END",
    "HOUR_APPR_PROCESS_START": "CAST(o_orderkey % 24 AS INTEGER)",
    "RATE_DOWN_PAYMENT": "CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 100) / 128e0 END",
    "DAYS_DECISION": "{day}",
    "CNT_PAYMENT": "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 60 AS DOUBLE) END",
    "DAYS_TERMINATION": "CASE WHEN o_orderkey % 11 = 0 THEN 365243e0 ELSE CAST({day} AS DOUBLE) END",
})
POS = ("events", "ts", {
    "SK_ID_CURR": "user_id",
    "MONTHS_BALANCE": "CAST(-(event_id % 90) AS INTEGER)",
    "SK_DPD": "CAST(event_id % 40 AS INTEGER)",
    "SK_DPD_DEF": "CAST(event_id % 13 AS INTEGER)",
    "NAME_CONTRACT_STATUS": "CASE WHEN event_id % 9 <> 0 THEN event_type END",
})
PAYMENTS = ("lineitem", "l_shipdate", {
    "SK_ID_CURR": "l_suppkey",
    "NUM_INSTALMENT_VERSION": "CASE WHEN l_quantity <> 13 THEN CAST(l_linenumber AS DOUBLE) END",
    "AMT_INSTALMENT": "CASE WHEN l_partkey % 900 = 7 THEN 0e0 ELSE round(l_extendedprice * 100) END",
    "AMT_PAYMENT": "CASE WHEN l_quantity = 13 THEN NULL WHEN l_partkey % 900 = 7 AND l_linenumber < 4 "
                   "THEN 0e0 ELSE round(l_extendedprice * 100) - 100 * l_linenumber END",
    "DAYS_INSTALMENT": "CAST({day} AS DOUBLE)",
    "DAYS_ENTRY_PAYMENT": "CASE WHEN l_quantity <> 13 THEN CAST({day} + l_linenumber - 4 AS DOUBLE) END",
})
CARDS = ("events", "ts", {
    "SK_ID_PREV": "event_id",
    "SK_ID_CURR": "user_id",
    "MONTHS_BALANCE": "CAST(-(event_id % 90) AS INTEGER)",
    "AMT_BALANCE": "CASE WHEN event_id % 4 <> 0 THEN round(value * 100) END",
    "NAME_CONTRACT_STATUS": "CASE WHEN event_id % 9 <> 0 THEN event_type END",
})
_SCORE = "CASE WHEN c_custkey % {gap} <> 0 THEN (c_custkey % {m}) / 128e0 END"
APPLICATION = ("customer", None, {
    "SK_ID_CURR": "c_custkey",
    "TARGET": "CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END",
    "AMT_INCOME_TOTAL": "round(c_acctbal * 100) + 200000",
    "AMT_CREDIT": "CASE WHEN c_custkey % 17 = 0 THEN 0e0 ELSE c_custkey * 100e0 + 1 END",
    "AMT_ANNUITY": "CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey * 10e0 END",
    "AMT_GOODS_PRICE": "CASE WHEN c_custkey % 6 <> 0 THEN c_custkey * 90e0 + 9 END",
    "AMT_REQ_CREDIT_BUREAU_QRT": "CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 31 = 0 "
                                 "THEN 261e0 ELSE 1e0 END",
    "OBS_30_CNT_SOCIAL_CIRCLE": "CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 41 = 0 "
                                "THEN 348e0 ELSE 2e0 END",
    "DAYS_EMPLOYED": "CASE WHEN c_custkey % 9 = 0 THEN 365243 ELSE CAST(-(c_custkey % 5000) AS INTEGER) END",
    "DAYS_BIRTH": "CAST(-7000 - (c_custkey * 13) % 20000 AS INTEGER)",
    "DAYS_LAST_PHONE_CHANGE": "CASE WHEN c_custkey % 4 <> 0 THEN -(c_custkey % 1000) * 1e0 END",
    "OWN_CAR_AGE": "CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 30) * 1e0 END",
    "CNT_FAM_MEMBERS": "CASE WHEN c_custkey % 19 <> 0 THEN (c_custkey % 5) * 1e0 END",
    "CNT_CHILDREN": "CAST(c_custkey % 4 AS INTEGER)",
    "EXT_SOURCE_1": _SCORE.format(gap=2, m=101),
    "EXT_SOURCE_2": _SCORE.format(gap=7, m=89),
    "EXT_SOURCE_3": _SCORE.format(gap=3, m=113),
    "FLAG_DOCUMENT_2": "CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END",
    "FLAG_DOCUMENT_4": "CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END",
    "FLAG_DOCUMENT_5": "CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END",
    "FLAG_DOCUMENT_6": "CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END",
    "FLAG_DOCUMENT_7": "CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END",
    "FLAG_MOBIL": "1",
    "FLAG_EMAIL": "CASE WHEN c_nationkey > 9 THEN 1 ELSE 0 END",
    "FLAG_OWN_CAR": "CASE WHEN c_custkey % 3 = 0 THEN 'Y' ELSE 'N' END",
    "CODE_GENDER": "CASE WHEN c_custkey % 43 = 0 THEN 'XNA' WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END",
    "ORGANIZATION_TYPE": "c_mktsegment",
})


_ROUNDED = re.compile(r"round\(([^()]*)\)")


def whole_number(x: str) -> str:
    """``round(x)`` of a double, halves away from zero, in Spark but without its decimal per value."""
    half = f"abs({x} - rint({x})) = 5e-1"
    return f"CASE WHEN {half} THEN {x} + signum({x}) * 5e-1 ELSE rint({x}) END + 0e0"


def role(spark: SparkSession, sf: str, mapping) -> DataFrame:
    table, day_of, columns = mapping
    day = _DAY["spark"].format(c=day_of)
    named = [f"{e.replace('{day}', day)} AS {c}" for c, e in columns.items()]
    # Columns that round the same value share one column of whole numbers.
    rounded = list(dict.fromkeys(x for e in named for x in _ROUNDED.findall(e)))
    named = [_ROUNDED.sub(lambda m: f"__whole_{rounded.index(m[1])}", e) for e in named]
    wholes = [f"{whole_number(x)} AS __whole_{i}" for i, x in enumerate(rounded)]
    return load_table(spark, sf, table).selectExpr("*", *wholes).selectExpr(*named)


def role_sql(mapping) -> str:
    table, day_of, columns = mapping
    day = _DAY["sql"].format(c=day_of)
    named = ", ".join(f"{e.replace('{day}', day)} AS {c}" for c, e in columns.items())
    return f"SELECT {named} FROM {table}"


def clipped_sql(source: str, columns: list[str], rest: list[str], trigger: float = 3) -> str:
    """Clip of the listed columns to three deviations, beyond a number of them."""
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in columns)
    clips = ", ".join(
        f"CASE WHEN {c} - m_{c} > {trigger} * s_{c} THEN m_{c} + 3 * s_{c} "
        f"WHEN m_{c} - {c} > {trigger} * s_{c} THEN m_{c} - 3 * s_{c} ELSE {c} END AS {c}"
        for c in columns
    )
    return f"SELECT {', '.join(rest)}, {clips} FROM ({source}), (SELECT {stats} FROM ({source}))"


# Columns whose sums are whole numbers.
_INTEGERS = {"CNT_CREDIT_PROLONG", "MONTHS_BALANCE", "MONTHS_BALANCE_SIZE"}


def rounded_sql(value: str, scale) -> str:
    """Round to a number of digits (int), or divide by a scale (float) and round to four.

    The scales are not powers of ten, so that no exact value falls on a rounding edge.
    """
    if isinstance(scale, int):
        return f"round({value}, {scale})"
    return f"round(({value}) / {scale}::DOUBLE, 4)"


def spec_sql(prefix: str, spec: dict, where: str | None = None, scales: dict | None = None) -> list[str]:
    """Aggregates of a specification in SQL, over all rows or over those of a condition.

    Results that involve an infinity are NULL; outputs in ``scales`` are scaled and rounded.
    """
    w = f"FILTER (WHERE {where})" if where else ""
    rows = f"count(*) {w}"
    outputs = []
    for c, functions in spec.items():
        ratio = c.endswith("_PERC")
        value = f"CASE WHEN isfinite({c}) THEN {c} END" if ratio else c
        infinite = f"count(CASE WHEN isinf({c}) THEN 1 END) {w}" if ratio else "0"
        for f in functions.split():
            if f in ("min", "max"):
                result = f"{f}({c}) {w}"
                result = sql_finite(result) if ratio else result
            elif f == "mean":
                result = f"CASE WHEN {infinite} = 0 THEN avg({value}) {w} END"
            elif f == "sum":
                result = f"CASE WHEN {infinite} = 0 THEN coalesce(sum({value}) {w}, 0) END"
                if where:
                    result = f"CASE WHEN {rows} > 0 THEN {result} END"
                if c in _INTEGERS:
                    result = f"CAST({result} AS BIGINT)"
            elif f == "var":
                result = f"CASE WHEN {infinite} = 0 THEN var_samp({value}) {w} END"
            elif f == "size":
                result = f"CAST({f'nullif({rows}, 0)' if where else rows} AS BIGINT)"
            else:
                result = f"CAST(count(DISTINCT {c}) {w} AS BIGINT)"
            name = "_".join(p for p in (prefix, c, f.upper()) if p)
            scale = (scales or {}).get(f"{c}_{f.upper()}")
            result = rounded_sql(result, scale) if scale else result
            outputs.append(f'{result} AS "{name}"')
    return outputs


def rate_sql(prefix: str, found: dict) -> list[str]:
    return [
        f"avg(CASE WHEN {c} {f'''= '{v}' ''' if v else 'IS NULL'} THEN 1 ELSE 0 END) "
        f'AS "{prefix}_{c}_{v or "nan"}_MEAN"'
        for c, known in found.items()
        for v in [*known, None]
    ]


def comparable(df: DataFrame, prefixes, scales: dict) -> DataFrame:
    """Scale and round what is not an exact sum, and blank infinite ratios."""
    out = {}
    for c in df.columns:
        if "_PERC_" in c:
            out[c] = inside(F.col(c))
        for p in prefixes:
            scale = scales.get(c.removeprefix(f"{p}_")) if c.startswith(f"{p}_") else None
            if scale:
                value = out.get(c, F.col(c))
                out[c] = F.round(value, scale) if isinstance(scale, int) else F.round(value / F.lit(scale), 4)
    return df.withColumns(out)


_PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_EVENTS = ["click", "error", "purchase", "signup", "view"]
_BUREAU_SCALES = {"DAYS_CREDIT_VAR": 997.0, "AMT_CREDIT_MAX_OVERDUE_MEAN": 3}


def _bureau_sql(trigger: float = 3):
    clip = [c for c in BUREAU[2] if c.startswith("AMT_") and c != "AMT_CREDIT_SUM_OVERDUE"]
    rest = [c for c in BUREAU[2] if c not in clip]
    status = {"STATUS": ["F", "O"]}
    rolled = spec_sql("", history.BALANCE_SPEC) + [
        e.replace('"_STATUS', '"STATUS') for e in rate_sql("", status)
    ]
    outputs = spec_sql("BURO", history.BUREAU_SPEC, None, _BUREAU_SCALES)
    for prefix, level in history.BUREAU_SUBSETS.items():
        outputs += spec_sql(prefix, history.BUREAU_SPEC, f"CREDIT_ACTIVE = '{level}'", _BUREAU_SCALES)
    outputs += rate_sql("BURO", {"CREDIT_ACTIVE": ["Active", "Bad debt", "Closed"], "CREDIT_TYPE": _PRIORITY})
    outputs += [
        f'round(avg("STATUS_{v}_MEAN"), 8) AS "BURO_STATUS_{v}_MEAN_MEAN"' for v in ("F", "O", "nan")
    ]
    return f"""WITH credit AS ({clipped_sql(role_sql(BUREAU), clip, rest, trigger)}),
        rolled AS (SELECT SK_ID_BUREAU, {", ".join(rolled)} FROM ({role_sql(BALANCE)}) GROUP BY 1)
        SELECT SK_ID_CURR, {", ".join(outputs)}
        FROM credit LEFT JOIN rolled USING (SK_ID_BUREAU)
        WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR"""


@register("bureau_like", _bureau_sql())
def _(spark, sf):
    out = history.bureau_features(role(spark, sf, BUREAU), role(spark, sf, BALANCE))
    return comparable(out, *_COMPARED["bureau"])


_PREVIOUS_SCALES = {"APP_CREDIT_PERC_MEAN": 0.0097, "APP_CREDIT_PERC_VAR": 0.0097}


def _previous_sql():
    source = f"SELECT *, {sql_ratio('AMT_APPLICATION', 'AMT_CREDIT')} AS APP_CREDIT_PERC FROM ({role_sql(PREVIOUS)})"
    outputs = spec_sql("PREV", history.PREVIOUS_SPEC, None, _PREVIOUS_SCALES)
    for prefix, level in history.PREVIOUS_SUBSETS.items():
        outputs += spec_sql(
            prefix, history.PREVIOUS_SPEC, f"NAME_CONTRACT_STATUS = '{level}'", _PREVIOUS_SCALES
        )
    outputs += rate_sql(
        "PREV",
        {"NAME_CONTRACT_STATUS": ["Approved", "Refused", "Unused offer"], "NAME_CONTRACT_TYPE": _PRIORITY},
    )
    approved = "count(*) FILTER (WHERE NAME_CONTRACT_STATUS = 'Approved')"
    return f"""SELECT SK_ID_CURR, {", ".join(outputs)}, CAST(count(*) AS BIGINT) AS "TOTAL_PREV_COUNT",
        CAST(nullif({approved}, 0) AS BIGINT) AS "APPROVED_COUNT",
        nullif({approved}, 0) / count(*) AS "APPROVAL_PERCENT"
        FROM ({source}) WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR"""


@register("previous_like", _previous_sql())
def _(spark, sf):
    out = history.previous_features(role(spark, sf, PREVIOUS), approval_rate=True)
    return comparable(out, *_COMPARED["previous"])


def _pos_sql():
    outputs = spec_sql("POS", history.POS_SPEC) + rate_sql("POS", {"NAME_CONTRACT_STATUS": _EVENTS})
    return f"""SELECT SK_ID_CURR, {", ".join(outputs)}, CAST(count(*) AS BIGINT) AS "POS_COUNT"
        FROM ({role_sql(POS)}) GROUP BY SK_ID_CURR"""


@register("pos_like", _pos_sql())
def _(spark, sf):
    return history.pos_features(role(spark, sf, POS))


_PAYMENT_SCALES = {
    "PAYMENT_PERC_MEAN": 0.0097, "PAYMENT_PERC_SUM": 0.97, "PAYMENT_PERC_VAR": 0.000097,
    "PAYMENT_DIFF_VAR": 999983000.0,
}


def _payment_sql():
    outputs = spec_sql("INSTAL", history.INSTALMENT_SPEC, None, _PAYMENT_SCALES)
    return f"""SELECT SK_ID_CURR, {", ".join(outputs)}, CAST(count(*) AS BIGINT) AS "INSTAL_COUNT"
        FROM (SELECT *, {sql_ratio("AMT_PAYMENT", "AMT_INSTALMENT")} AS PAYMENT_PERC,
                     AMT_INSTALMENT - AMT_PAYMENT AS PAYMENT_DIFF,
                     CASE WHEN DAYS_ENTRY_PAYMENT > DAYS_INSTALMENT
                          THEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT ELSE 0e0 END AS DPD,
                     CASE WHEN DAYS_INSTALMENT > DAYS_ENTRY_PAYMENT
                          THEN DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT ELSE 0e0 END AS DBD
              FROM ({role_sql(PAYMENTS)})) GROUP BY SK_ID_CURR"""


@register("installment_like", _payment_sql())
def _(spark, sf):
    out = history.instalment_features(role(spark, sf, PAYMENTS))
    return comparable(out, *_COMPARED["payments"])


def _card_sql():
    scales = {"MONTHS_BALANCE_VAR": 7.0, "AMT_BALANCE_VAR": 999983.0}
    spec = {"MONTHS_BALANCE": "min max mean sum var", "AMT_BALANCE": "min max mean sum var"}
    outputs = spec_sql("CC", spec, None, scales)
    for v in [*_EVENTS, None]:
        test = f"= '{v}'" if v else "IS NULL"
        hit = f"CASE WHEN NAME_CONTRACT_STATUS {test} THEN 1 ELSE 0 END"
        name = f"CC_NAME_CONTRACT_STATUS_{v or 'nan'}"
        outputs += [
            f'min({hit}) AS "{name}_MIN"', f'max({hit}) AS "{name}_MAX"', f'avg({hit}) AS "{name}_MEAN"',
            f'CAST(sum({hit}) AS BIGINT) AS "{name}_SUM"', f'round(var_samp({hit}) / 0.7::DOUBLE, 4) AS "{name}_VAR"',
        ]
    return f"""SELECT SK_ID_CURR, {", ".join(outputs)}, CAST(count(*) AS BIGINT) AS "CC_COUNT"
        FROM ({role_sql(CARDS)}) GROUP BY SK_ID_CURR"""


@register("card_like", _card_sql())
def _(spark, sf):
    out = history.card_features(role(spark, sf, CARDS))
    return comparable(out, *_COMPARED["cards"])


# Prefixes and scales under which the results of each history table are compared.
_COMPARED = {
    "bureau": (
        ["BURO", *history.BUREAU_SUBSETS],
        {**_BUREAU_SCALES, **{f"STATUS_{v}_MEAN_MEAN": 8 for v in ("F", "O", "nan")}},
    ),
    "previous": (["PREV", *history.PREVIOUS_SUBSETS], _PREVIOUS_SCALES),
    "payments": (["INSTAL"], _PAYMENT_SCALES),
    "cards": (
        ["CC"],
        {"MONTHS_BALANCE_VAR": 7.0, "AMT_BALANCE_VAR": 999983.0,
         **{f"NAME_CONTRACT_STATUS_{v}_VAR": 0.7 for v in [*_EVENTS, "nan"]}},
    ),
}


_RATIO_NAMES = [*application.RATIOS, *application.ONE_PLUS_RATIOS]


def _application_sql(source: str | None = None, fitted: str = "true", kept: str = "SK_ID_CURR"):
    """Features of the rows of a source; statistics come from the rows that are ``fitted``."""
    source = source or role_sql(APPLICATION)
    scores, documents = application.SCORES, [c for c in APPLICATION[2] if "FLAG_DOC" in c]
    outputs = []
    for name, (a, b) in application.RATIOS.items():
        outputs.append(f"{sql_finite('(' + sql_ratio(a, b) + ')')} AS \"{name}\"")
    for name, (a, b) in application.ONE_PLUS_RATIOS.items():
        outputs.append(f'{a} / (1 + {b}) AS "{name}"')
    outputs.append(f"{sql_class('(' + sql_ratio('AMT_INCOME_TOTAL', 'AMT_CREDIT') + ')')} AS income_class")
    for a, b in application.SCORE_PAIRS:
        x, y = scores[a - 1], scores[b - 1]
        shifted = [f"coalesce({c}, -1e0) + 0.1::DOUBLE" for c in (x, y)]
        outputs.append(f'{sql_ratio(*shifted)} AS "EXT_SOURCE_{a}over{b}_NAminus1_Add0.1"')
        outputs.append(
            f'CASE WHEN {x} IS NULL THEN coalesce({y}, 0e0) ELSE 0e0 END AS "EXT_SOURCE_na{a}_{b}"'
        )
    outputs += [
        'FLAG_MOBIL + FLAG_EMAIL AS "NEW_LIVE_IND_SUM"',
        f'{" * ".join(scores)} AS "NEW_SOURCES_PROD"',
        'score_mean AS "NEW_EXT_SOURCES_MEAN"',
        'round(coalesce(score_std, avg_std), 6) AS "NEW_SCORES_STD"',
        'income AS "NEW_INC_BY_ORG"',
        """round(CASE WHEN m2 < 1e-14 THEN 0 ELSE 5 * 6 * 4 * m4 / (3 * 2 * m2 * m2) - 3 * 4 * 4 / (3.0 * 2) END, 6)
           AS "NEW_DOC_IND_KURT\"""",
    ]
    n = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in scores)
    total = " + ".join(f"coalesce({c}, 0)" for c in scores)
    squares = " + ".join(f"coalesce(({c} - score_mean) * ({c} - score_mean), 0)" for c in scores)
    doc_mean = f"(({' + '.join(documents)}) / 5e0)"
    m2, m4 = (" + ".join(f"power({c} - {doc_mean}, {p})" for c in documents) for p in (2, 4))
    return f"""
    WITH app AS (SELECT * REPLACE (nullif(DAYS_EMPLOYED, 365243) AS DAYS_EMPLOYED) FROM ({source})),
    counted AS (SELECT *, {n} AS n, {total} AS total, {m2} AS m2, {m4} AS m4 FROM app),
    averaged AS (SELECT *, CASE WHEN n > 0 THEN total / n END AS score_mean FROM counted),
    spread AS (SELECT *, CASE WHEN n >= 2 THEN sqrt(({squares}) / (n - 1)) END AS score_std FROM averaged),
    organizations AS (SELECT ORGANIZATION_TYPE, median(AMT_INCOME_TOTAL) AS income
                      FROM spread WHERE {fitted} GROUP BY 1),
    wide AS (SELECT * FROM spread LEFT JOIN organizations USING (ORGANIZATION_TYPE),
                           (SELECT avg(score_std) AS avg_std FROM spread WHERE {fitted}))
    SELECT {kept}, {", ".join(outputs)} FROM wide WHERE CODE_GENDER IS DISTINCT FROM 'XNA'"""


@register("application_like", _application_sql())
def _(spark, sf):
    applications = role(spark, sf, APPLICATION)
    stats = application.fit_application(applications)
    out = application.application_features(applications, stats)
    added = [c for c in out.columns if c not in APPLICATION[2]]
    out = out.withColumn("income_class", number_class(F.col("INCOME_CREDIT_PERC")))
    blanked = {c: inside(F.col(c)) for c in _RATIO_NAMES}
    rounded = {c: F.round(c, 6) for c in ("NEW_SCORES_STD", "NEW_DOC_IND_KURT")}
    quoted = [F.col(f"`{c}`") for c in added]
    return out.withColumns({**blanked, **rounded}).select("SK_ID_CURR", *quoted, "income_class")


def _halves(spark, sf):
    marked = hash_split(role(spark, sf, APPLICATION), "SK_ID_CURR", 0.7, into="is_train", portable=True)
    return (
        marked.where("is_train").drop("is_train"),
        marked.where("NOT is_train").drop("is_train", "TARGET"),
    )


_MARKED = f"""SELECT *, ('0x' || substr(md5('314:' || SK_ID_CURR), 1, 13))::BIGINT
              < CAST(round(0.7 * 4503599627370496) AS BIGINT) AS is_train FROM ({role_sql(APPLICATION)})"""


def _age_sql():
    names = [*application.SCORES, "DAYS_BIRTH"]
    filled = {c: f"coalesce({c}, (SELECT median({c}) FROM aged WHERE is_train))" for c in names}
    terms = []
    for size in (2, 3):
        for factors in combinations_with_replacement(names, size):
            label = " ".join(
                c if factors.count(c) == 1 else f"{c}^{factors.count(c)}" for c in dict.fromkeys(factors)
            )
            terms.append(f'{" * ".join("f_" + c for c in factors)} AS "{label}"')
    fills = ", ".join(f"{e} AS f_{c}" for c, e in filled.items())
    return f"""WITH aged AS (SELECT * REPLACE (abs(DAYS_BIRTH) / 365 AS DAYS_BIRTH) FROM ({_MARKED})),
        filled AS (SELECT *, {fills} FROM aged)
        SELECT SK_ID_CURR, is_train, DAYS_BIRTH, EXT_SOURCE_1,
               CASE WHEN DAYS_BIRTH > 20 AND DAYS_BIRTH <= 70 THEN
                 format('({{:.1f}}, {{:.1f}}]', 20 + 5.0 * (ceil((DAYS_BIRTH - 20) / 5.0) - 1),
                        20 + 5.0 * ceil((DAYS_BIRTH - 20) / 5.0)) END AS "BIRTH_YEARS_BINNED",
               {", ".join(terms)} FROM filled"""


@register("age_poly_like", _age_sql())
def _(spark, sf):
    train, test = _halves(spark, sf)
    train, test = application.age_polynomials(train.drop("TARGET"), test)
    both = train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)))
    terms = [c for c in both.columns if "^" in c or " " in c]
    return both.select(
        "SK_ID_CURR", "is_train", "DAYS_BIRTH", "EXT_SOURCE_1", "BIRTH_YEARS_BINNED",
        *[F.col(f"`{c}`") for c in terms],
    )


_ENCODED = {"FLAG_OWN_CAR": ["N", "Y"], "CODE_GENDER": ["F", "M"]}


def _matrix_sql():
    kept = ["AMT_INCOME_TOTAL", "AMT_ANNUITY", "EXT_SOURCE_1"]
    dummies = [
        f'CASE WHEN {c} = \'{v}\' THEN 1 ELSE 0 END AS "{c}_{v}"' for c, known in _ENCODED.items() for v in known
    ]
    pos = ["POS_SK_DPD_MAX", "POS_MONTHS_BALANCE_MEAN", "POS_COUNT"]
    return f"""SELECT SK_ID_CURR, is_train, CASE WHEN is_train THEN "TARGET" END AS "TARGET",
        {", ".join(f'coalesce({c}, 0) AS "{c}"' for c in [*kept, *pos])}, {", ".join(dummies)}
        FROM ({_MARKED}) LEFT JOIN ({_pos_sql()}) USING (SK_ID_CURR)
        WHERE (NOT is_train OR (AMT_REQ_CREDIT_BUREAU_QRT IS DISTINCT FROM 261 AND OBS_30_CNT_SOCIAL_CIRCLE < 300))
          AND CODE_GENDER IS DISTINCT FROM 'XNA'"""


@register("matrix_like", _matrix_sql())
def _(spark, sf):
    """Train-only cleaning, encoding to shared columns, assembly and final fill."""
    train, test = _halves(spark, sf)
    options = scoring.Options()
    train, test = scoring.application_matrices(train, test, options)
    left, right = scoring.model_matrices(
        train, test, [history.pos_features(role(spark, sf, POS))], options
    )
    both = left.withColumn("is_train", F.lit(True)).unionByName(
        right.withColumn("is_train", F.lit(False)), allowMissingColumns=True
    )
    return both.select(
        "SK_ID_CURR", "is_train", "TARGET", "AMT_INCOME_TOTAL", "AMT_ANNUITY", "EXT_SOURCE_1",
        "POS_SK_DPD_MAX", "POS_MONTHS_BALANCE_MEAN", "POS_COUNT",
        *[f"{c}_{v}" for c, known in _ENCODED.items() for v in known],
    )


_IS_CLEAN = "AMT_REQ_CREDIT_BUREAU_QRT IS DISTINCT FROM 261 AND OBS_30_CNT_SOCIAL_CIRCLE < 300"
# The level XNA is left out: its rows are dropped, so its column is 0 where both sides had it.
_CATEGORIES = {
    "FLAG_OWN_CAR": ["N", "Y"],
    "CODE_GENDER": ["F", "M"],
    "ORGANIZATION_TYPE": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
}


def _quoted_names(sql: str) -> list[str]:
    """Names of the outputs of the last SELECT of clients, as far as they are quoted."""
    return re.findall(r'AS "([^"]+)"', sql[sql.rindex("SELECT SK_ID_CURR") :])


def _full_matrix_sql(options: scoring.Options) -> str:
    """Every column of both matrices in SQL: applications, encoding and five histories."""
    polynomial = options.age_polynomials
    previous = _previous_sql()
    gone = set() if options.approval_rate else {"TOTAL_PREV_COUNT", "APPROVED_COUNT", "APPROVAL_PERCENT"}
    histories = [_bureau_sql(options.clip_trigger), previous, _pos_sql(), _payment_sql(), _card_sql()]
    source, fitted = f"SELECT * FROM ({_MARKED})", f"is_train AND {_IS_CLEAN}"
    age = _age_sql()
    if polynomial:
        source = f"SELECT * REPLACE (abs(DAYS_BIRTH) / 365 AS DAYS_BIRTH) FROM ({source})"
    raw = [c for c in APPLICATION[2] if c not in ("SK_ID_CURR", "TARGET", *_CATEGORIES)]
    kept = "SK_ID_CURR, is_train, TARGET, " + ", ".join([*raw, *_CATEGORIES])
    features = _application_sql(source, fitted, kept)
    names = [*raw, *_quoted_names(features)]
    for sql in histories:
        names += [n for n in _quoted_names(sql) if n not in gone]
    dummies = [(c, v) for c, known in _CATEGORIES.items() for v in known]
    terms = []
    if polynomial:
        terms = [n for n in _quoted_names(age) if n != "BIRTH_YEARS_BINNED"]
        dummies += [("BIRTH_YEARS_BINNED", v) for v in bin_labels(20.0, 70.0, 10)]

    def plain(name):
        return re.sub(r"\W", "_", name)

    outputs = [f'coalesce("{n}", 0) AS "{plain(n)}"' for n in [*names, *terms]]
    outputs += [
        f"""CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS "{plain(f'{c}_{v}')}\"""" for c, v in dummies
    ]
    joins = "".join(f" LEFT JOIN ({sql}) USING (SK_ID_CURR)" for sql in histories)
    if polynomial:
        wanted = ", ".join(f'"{n}"' for n in ["BIRTH_YEARS_BINNED", *terms])
        joins += f" LEFT JOIN (SELECT SK_ID_CURR, {wanted} FROM ({age})) USING (SK_ID_CURR)"
    return f"""SELECT SK_ID_CURR, is_train, CASE WHEN is_train THEN "TARGET" END AS "TARGET",
        {", ".join(outputs)} FROM ({features}) {joins} WHERE NOT is_train OR ({_IS_CLEAN})"""


def _history_roles(spark, sf) -> dict[str, DataFrame]:
    return {
        "bureau": role(spark, sf, BUREAU),
        "bureau_balance": role(spark, sf, BALANCE),
        "previous_application": role(spark, sf, PREVIOUS),
        "pos_cash_balance": role(spark, sf, POS),
        "installments_payments": role(spark, sf, PAYMENTS),
        "credit_card_balance": role(spark, sf, CARDS),
    }


def _full_matrices(spark, sf, options, compared: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both matrices from all tables; ``compared`` rounds what is no exact sum."""
    train, test = scoring.application_matrices(*_halves(spark, sf), options)
    features = scoring.client_features(_history_roles(spark, sf), options)
    if compared:
        bureau, previous, pos, payments, cards = features
        features = [
            comparable(bureau, *_COMPARED["bureau"]), comparable(previous, *_COMPARED["previous"]),
            pos, comparable(payments, *_COMPARED["payments"]), comparable(cards, *_COMPARED["cards"]),
        ]
    return scoring.model_matrices(train, test, features, options)


def _full_matrix(spark, sf, options) -> DataFrame:
    left, right = _full_matrices(spark, sf, options, compared=True)
    both = left.withColumn("is_train", F.lit(True)).unionByName(
        right.withColumn("is_train", F.lit(False)), allowMissingColumns=True
    )
    return both.withColumns(
        {c: F.round(c, 6) for c in ("NEW_SCORES_STD", "NEW_DOC_IND_KURT")}
    ).drop("CODE_GENDER_XNA")


@register("matrix_approval", _full_matrix_sql(scoring.VARIANTS["approval"]))
def _(spark, sf):
    """All columns of both matrices, from applications and five histories, with approval rates."""
    return _full_matrix(spark, sf, scoring.VARIANTS["approval"])


@register("matrix_polynomial", _full_matrix_sql(scoring.VARIANTS["polynomial"]))
def _(spark, sf):
    """The same without these rates, with age bins, polynomials and the wider clip trigger."""
    return _full_matrix(spark, sf, scoring.VARIANTS["polynomial"])


def _client_scores(spark, sf, again: bool) -> DataFrame:
    # The role of the label follows from a column: its loss falls for ever, below 1 % is the end.
    small = {"maxDepth": 3, "minInstancesPerNode": 5, "validationTol": 0.01}
    options = scoring.Options(parameters=small)

    def build():
        train, test = _full_matrices(spark, sf, options)
        return materialize(M.score(scoring.train_model(train, options), test, "SK_ID_CURR"), "scores")

    return kept(spark, sf, ("customer", "orders", "lineitem", "events"), "client scores", build, again)


@register("score_like")
def _(spark, sf):
    """From role tables, five histories among them, to one score per client to be scored."""
    return _client_scores(spark, sf, again=True)


@register(
    "score_like_facts",
    f"""SELECT SK_ID_CURR, true AS is_probability FROM ({_MARKED})
        WHERE NOT is_train AND CODE_GENDER IS DISTINCT FROM 'XNA'""",
)
def _(spark, sf):
    """What SQL can say about the scores: each client to be scored has one, a probability."""
    scores = _client_scores(spark, sf, again=False)
    return scores.select("SK_ID_CURR", F.col("TARGET").between(0, 1).alias("is_probability"))


@register(
    "score_like_decisions",
    f"""SELECT SK_ID_CURR, CASE WHEN abs(c_acctbal - 5000) > 1000 THEN c_acctbal > 5000 END AS says_yes
        FROM ({_MARKED}) JOIN customer ON c_custkey = SK_ID_CURR
        WHERE NOT is_train AND CODE_GENDER IS DISTINCT FROM 'XNA'""",
)
def _(spark, sf):
    """The label follows from a column that the model is not told of: it is found on all clients
    to be scored that are not near the border."""
    balances = load_table(spark, sf, "customer").selectExpr(
        "c_custkey AS SK_ID_CURR", "abs(c_acctbal - 5000) > 1000 AS is_clear"
    )
    scores = _client_scores(spark, sf, again=False).join(balances, "SK_ID_CURR")
    return scores.select("SK_ID_CURR", F.when(F.col("is_clear"), F.col("TARGET") > 0.5).alias("says_yes"))
