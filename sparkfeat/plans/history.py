"""Client features from the history tables: each function returns one row per client."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfeat.functions import ieee_div, positive_part
from sparkfeat.functions.missing import sentinel_to_null, text_literal
from sparkfeat.operators.aggregate import (
    Subset,
    aggregate,
    aggregate_all,
    two_level,
    with_missing_level,
)
from sparkfeat.operators.columns import drop_strict, sentinels_to_null
from sparkfeat.operators.encode import MAX_LEVELS
from sparkfeat.operators.encode import levels as find_levels
from sparkfeat.operators.fitted import apply_sigma_clip, sigma_clip
from sparkfeat.operators.observed import Statistics

KnownLevels = Mapping[str, Sequence[str]] | None

# Key names, the "unknown day" number, output prefixes, category levels that
# select subsets, and the aggregates of each column.
CLIENT = "SK_ID_CURR"
CREDIT = "SK_ID_BUREAU"
LOAN = "SK_ID_PREV"
UNKNOWN_DAYS = 365243

BALANCE_SPEC = {"MONTHS_BALANCE": "min max size"}
BUREAU_SPEC = {
    "DAYS_CREDIT": "min max mean var",
    "DAYS_CREDIT_ENDDATE": "min max mean",
    "DAYS_CREDIT_UPDATE": "mean",
    "CREDIT_DAY_OVERDUE": "max mean",
    "AMT_CREDIT_MAX_OVERDUE": "mean",
    "AMT_CREDIT_SUM": "max mean sum",
    "AMT_CREDIT_SUM_DEBT": "max mean sum",
    "AMT_CREDIT_SUM_OVERDUE": "mean",
    "AMT_CREDIT_SUM_LIMIT": "mean sum",
    "AMT_ANNUITY": "max mean",
    "CNT_CREDIT_PROLONG": "sum",
    "MONTHS_BALANCE_MIN": "min",
    "MONTHS_BALANCE_MAX": "max",
    "MONTHS_BALANCE_SIZE": "mean sum",
}
BUREAU_SUBSETS = {"ACTIVE": "Active", "CLOSED": "Closed"}
PREVIOUS_SENTINEL_DAYS = [
    "DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE",
    "DAYS_TERMINATION",
]
PREVIOUS_SPEC = {
    "AMT_ANNUITY": "min max mean",
    "AMT_APPLICATION": "min max mean",
    "AMT_CREDIT": "min max mean",
    "APP_CREDIT_PERC": "min max mean var",
    "AMT_DOWN_PAYMENT": "min max mean",
    "AMT_GOODS_PRICE": "min max mean",
    "HOUR_APPR_PROCESS_START": "min max mean",
    "RATE_DOWN_PAYMENT": "min max mean",
    "DAYS_DECISION": "min max mean",
    "CNT_PAYMENT": "mean sum",
}
PREVIOUS_SUBSETS = {"APPROVED": "Approved", "REFUSED": "Refused"}
POS_SPEC = {
    "MONTHS_BALANCE": "max mean size",
    "SK_DPD": "max mean",
    "SK_DPD_DEF": "max mean",
}
INSTALMENT_SPEC = {
    "NUM_INSTALMENT_VERSION": "nunique",
    "DPD": "max mean sum",
    "DBD": "max mean sum",
    "PAYMENT_PERC": "max mean sum var",
    "PAYMENT_DIFF": "max mean sum var",
    "AMT_INSTALMENT": "max mean sum",
    "AMT_PAYMENT": "min max mean sum",
    "DAYS_ENTRY_PAYMENT": "max mean sum",
}


def _levels(df: DataFrame, known: KnownLevels, most: int) -> dict:
    found = find_levels(df, max_levels=most) if known is None else known
    return with_missing_level(found)


def _clipped(df: DataFrame, trigger: float, statistics: Statistics | None) -> DataFrame:
    if statistics is None:
        return sigma_clip(df, trigger=trigger)
    return apply_sigma_clip(df, statistics.clip(), trigger=trigger)


def known_days() -> dict[str, Column]:
    """The day columns of earlier applications without the number that means "unknown"."""
    return {c: sentinel_to_null(c, UNKNOWN_DAYS) for c in PREVIOUS_SENTINEL_DAYS}


def bureau_features(
    bureau: DataFrame,
    balance: DataFrame,
    *,
    trigger: float = 3.0,
    bureau_levels: KnownLevels = None,
    balance_levels: KnownLevels = None,
    subsets: Mapping[str, str] = BUREAU_SUBSETS,
    max_levels: int = MAX_LEVELS,
    statistics: Statistics | None = None,
) -> DataFrame:
    """External credits per client: months roll up to credits, credits to clients.

    All credits and the active and closed ones are aggregated in one pass, on the raw status.
    With the ``statistics`` of the credits no scan is needed to clip them.
    """
    status = _levels(balance, balance_levels, max_levels)
    credits, added = two_level(
        balance, _clipped(bureau, trigger, statistics), CREDIT, BALANCE_SPEC, status
    )
    status_means = [c for c in added if c not in BUREAU_SPEC]
    return aggregate(
        drop_strict(credits, CREDIT),
        CLIENT,
        BUREAU_SPEC,
        prefix="BURO",
        rates=_levels(bureau, bureau_levels, max_levels),
        subsets=[
            Subset(p, f"CREDIT_ACTIVE = {text_literal(v)}") for p, v in subsets.items()
        ],
        extra={c: "mean" for c in status_means},
    )


def previous_features(
    previous: DataFrame,
    *,
    trigger: float = 3.0,
    clip_first: bool = False,
    approval_rate: bool = False,
    known_levels: KnownLevels = None,
    subsets: Mapping[str, str] = PREVIOUS_SUBSETS,
    max_levels: int = MAX_LEVELS,
    statistics: Statistics | None = None,
) -> DataFrame:
    """Earlier applications per client: all, approved and refused ones in one pass.

    The "unknown day" number becomes missing before clipping, so that it does not move mean and
    deviation; ``clip_first`` does it the other way round. ``approval_rate`` adds the client's
    number of applications, of approved ones, and their ratio. ``statistics`` of the table, with
    unknown days missing (see :func:`known_days`), spare the scan that clipping needs.
    """
    found = _levels(previous, known_levels, max_levels)
    if clip_first:
        previous = sigma_clip(previous, trigger=trigger)
    days = [c for c in PREVIOUS_SENTINEL_DAYS if c in previous.columns]
    if days:
        previous = sentinels_to_null(previous, days, UNKNOWN_DAYS)
    if not clip_first:
        previous = _clipped(previous, trigger, statistics)
    previous = previous.withColumn("APP_CREDIT_PERC", ieee_div("AMT_APPLICATION", "AMT_CREDIT"))
    status = "NAME_CONTRACT_STATUS"
    cuts = [Subset(p, f"{status} = {text_literal(v)}") for p, v in subsets.items()]
    if not approval_rate:
        return aggregate(
            previous, CLIENT, PREVIOUS_SPEC, prefix="PREV", rates=found, subsets=cuts
        )
    approved = F.when(F.col(status) == subsets["APPROVED"], F.lit(1))
    counted = aggregate(
        previous.withColumn("is_approved", approved),
        CLIENT,
        PREVIOUS_SPEC,
        prefix="PREV",
        rates=found,
        subsets=cuts,
        extra={"is_approved": "sum"},
        count_as="TOTAL_PREV_COUNT",
    )
    return counted.withColumns(
        {
            "APPROVED_COUNT": F.nullif(F.col("PREV_is_approved_SUM"), F.lit(0)),
            "APPROVAL_PERCENT": ieee_div(
                F.nullif(F.col("PREV_is_approved_SUM"), F.lit(0)), "TOTAL_PREV_COUNT"
            ),
        }
    ).drop("PREV_is_approved_SUM")


def pos_features(
    pos: DataFrame, *, known_levels: KnownLevels = None, max_levels: int = MAX_LEVELS
) -> DataFrame:
    """Months of point-of-sale and cash loans per client."""
    return aggregate(
        pos,
        CLIENT,
        POS_SPEC,
        prefix="POS",
        rates=_levels(pos, known_levels, max_levels),
        count_as="POS_COUNT",
    )


def instalment_features(
    payments: DataFrame, *, known_levels: KnownLevels = None, max_levels: int = MAX_LEVELS
) -> DataFrame:
    """Instalment payments per client: share and difference paid, days late and early."""
    late = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    derived = payments.withColumns(
        {
            "PAYMENT_PERC": ieee_div("AMT_PAYMENT", "AMT_INSTALMENT"),
            "PAYMENT_DIFF": F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT"),
            "DPD": positive_part(late),
            "DBD": positive_part(-late),
        }
    )
    return aggregate(
        derived,
        CLIENT,
        INSTALMENT_SPEC,
        prefix="INSTAL",
        rates=_levels(payments, known_levels, max_levels),
        count_as="INSTAL_COUNT",
    )


def card_features(
    cards: DataFrame, *, known_levels: KnownLevels = None, max_levels: int = MAX_LEVELS
) -> DataFrame:
    """Card months per client: five aggregates of every column and of every category level."""
    found = _levels(cards, known_levels, max_levels)
    return aggregate_all(
        drop_strict(cards, LOAN), CLIENT, prefix="CC", levels=found, count_as="CC_COUNT"
    )
