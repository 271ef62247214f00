from sparkfeat.functions.missing import (
    as_column,
    differs_or_missing,
    finite_or_zero,
    ieee_div,
    nan_to_null,
    positive_part,
    sentinel_to_null,
)
from sparkfeat.functions.rowwise import (
    missing_interaction,
    offset_ratio,
    row_mean,
    row_product,
    row_sum,
    with_row_stats,
)

__all__ = [
    "as_column",
    "differs_or_missing",
    "finite_or_zero",
    "ieee_div",
    "missing_interaction",
    "nan_to_null",
    "offset_ratio",
    "positive_part",
    "row_mean",
    "row_product",
    "row_sum",
    "sentinel_to_null",
    "with_row_stats",
]
