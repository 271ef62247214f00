"""Features of the application itself, and its encoding to model columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.functions import (
    ieee_div,
    missing_interaction,
    offset_ratio,
    row_mean,
    row_product,
    row_sum,
    sentinel_to_null,
    with_row_stats,
)
from sparkfeat.operators.columns import names_containing
from sparkfeat.operators.encode import MAX_LEVELS, align, levels
from sparkfeat.operators.expand import bin_label, bin_labels, equal_width_bin, polynomial_terms
from sparkfeat.operators.filters import clean_training_rows, keep_different
from sparkfeat.operators.fitted import Stats, apply_fill, fit_mean, fit_median
from sparkfeat.operators.joins import lookup
from sparkfeat.operators.profile import numeric_columns
from sparkfeat.operators.ranking import median
from sparkfeat.plans.history import UNKNOWN_DAYS
from sparkfeat.sources.store import materialize

# Rows excluded from training, score columns, and the names and operands of the
# ratio features.
TRAIN_EXCLUDED = {"AMT_INCOME_TOTAL": 1.17e8, "AMT_REQ_CREDIT_BUREAU_QRT": 261}
TRAIN_BELOW = {"OBS_30_CNT_SOCIAL_CIRCLE": 300}
SCORES = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
RATIOS = {
    "DAYS_EMPLOYED_PERC": ("DAYS_EMPLOYED", "DAYS_BIRTH"),
    "INCOME_CREDIT_PERC": ("AMT_INCOME_TOTAL", "AMT_CREDIT"),
    "INCOME_PER_PERSON": ("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
    "ANNUITY_INCOME_PERC": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "PAYMENT_RATE": ("AMT_ANNUITY", "AMT_CREDIT"),
    "NEW_CREDIT_TO_ANNUITY_RATIO": ("AMT_CREDIT", "AMT_ANNUITY"),
    "NEW_CREDIT_TO_GOODS_RATIO": ("AMT_CREDIT", "AMT_GOODS_PRICE"),
    "NEW_EMPLOY_TO_BIRTH_RATIO": ("DAYS_EMPLOYED", "DAYS_BIRTH"),
    "NEW_CAR_TO_BIRTH_RATIO": ("OWN_CAR_AGE", "DAYS_BIRTH"),
    "NEW_CAR_TO_EMPLOY_RATIO": ("OWN_CAR_AGE", "DAYS_EMPLOYED"),
    "NEW_PHONE_TO_BIRTH_RATIO": ("DAYS_LAST_PHONE_CHANGE", "DAYS_BIRTH"),
    "NEW_PHONE_TO_EMPLOY_RATIO": ("DAYS_LAST_PHONE_CHANGE", "DAYS_EMPLOYED"),
    "NEW_CREDIT_TO_INCOME_RATIO": ("AMT_CREDIT", "AMT_INCOME_TOTAL"),
}
ONE_PLUS_RATIOS = {
    "NEW_INC_PER_CHLD": ("AMT_INCOME_TOTAL", "CNT_CHILDREN"),
    "NEW_ANNUITY_TO_INCOME_RATIO": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
}
SCORE_PAIRS = [(1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2)]
AGE_LOW, AGE_HIGH, AGE_BINS = 20.0, 70.0, 10


@dataclass(frozen=True)
class ApplicationStats:
    """What the application features learn from a table."""

    income_by_organization: DataFrame
    score_std: Stats


def clean_applications(train: DataFrame) -> DataFrame:
    return clean_training_rows(train, TRAIN_EXCLUDED, TRAIN_BELOW)


def _with_score_std(df: DataFrame) -> DataFrame:
    return with_row_stats(df, SCORES, std="NEW_SCORES_STD")


def fit_application(train: DataFrame) -> ApplicationStats:
    """Median income per organization and mean score deviation.

    Fitted on the training table for both tables; fit on each table itself to get what a
    separate run over that table gives.
    """
    medians = median(train, ["ORGANIZATION_TYPE"], "AMT_INCOME_TOTAL")
    stored = materialize(medians.withColumnRenamed("median", "NEW_INC_BY_ORG"), "organizations")
    return ApplicationStats(
        stored,
        fit_mean(_with_score_std(train), ["NEW_SCORES_STD"]),
    )


def application_features(df: DataFrame, stats: ApplicationStats) -> DataFrame:
    """Ratio, row-wise and score features; drops the rows of unknown gender."""
    documents = names_containing(df, "FLAG_DOC")
    contact = names_containing(df, "FLAG_", without=["FLAG_DOC", "_FLAG_"])
    contact = [c for c in contact if c in numeric_columns(df)]
    df = df.withColumn("DAYS_EMPLOYED", sentinel_to_null("DAYS_EMPLOYED", UNKNOWN_DAYS))
    same_row = {name: ieee_div(a, b) for name, (a, b) in RATIOS.items()}
    same_row |= {
        name: ieee_div(a, F.lit(1) + F.col(b)) for name, (a, b) in ONE_PLUS_RATIOS.items()
    }
    same_row |= {
        "NEW_LIVE_IND_SUM": row_sum(contact),
        "NEW_SOURCES_PROD": row_product(SCORES),
        "NEW_EXT_SOURCES_MEAN": row_mean(SCORES),
    }
    for a, b in SCORE_PAIRS:
        first, second = SCORES[a - 1], SCORES[b - 1]
        same_row[f"EXT_SOURCE_{a}over{b}_NAminus1_Add0.1"] = offset_ratio(first, second)
        same_row[f"EXT_SOURCE_na{a}_{b}"] = missing_interaction(first, second)
    df = df.withColumns(same_row)
    df = with_row_stats(df, documents, kurtosis="NEW_DOC_IND_KURT")
    df = apply_fill(_with_score_std(df), stats.score_std)
    df = lookup(df, stats.income_by_organization, "ORGANIZATION_TYPE")
    return keep_different(df, "CODE_GENDER", "XNA")


def age_polynomials(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Age in years and its bin, and third-degree products of scores and age.

    Missing operands of the products are imputed by training medians, all in years; the
    original columns keep their missing values.
    """

    def in_years(df):
        return df.withColumn("DAYS_BIRTH", F.abs("DAYS_BIRTH") / F.lit(365))

    train, test = in_years(train), in_years(test)
    fills = fit_median(train, [*SCORES, "DAYS_BIRTH"])
    labels = bin_labels(AGE_LOW, AGE_HIGH, AGE_BINS)
    number = equal_width_bin("DAYS_BIRTH", AGE_LOW, AGE_HIGH, AGE_BINS)
    values = {c: F.coalesce(F.col(c), F.lit(s["fill"])) for c, s in fills.items()}
    new = {"BIRTH_YEARS_BINNED": bin_label(number, labels), **polynomial_terms(values, 3)}
    return train.withColumns(new), test.withColumns(new)


def application_levels(df: DataFrame, max_levels: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Category levels of the table as read, before any row is dropped.

    The age bins count as levels whether or not they occur.
    """
    found = levels(df, max_levels=max_levels)
    if "BIRTH_YEARS_BINNED" in df.columns:
        found["BIRTH_YEARS_BINNED"] = bin_labels(AGE_LOW, AGE_HIGH, AGE_BINS)
    return found


def encode_applications(
    train: DataFrame, test: DataFrame, train_levels=None, test_levels=None
) -> tuple[DataFrame, DataFrame]:
    return align(train, test, "TARGET", train_levels, test_levels)
