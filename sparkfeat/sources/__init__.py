from sparkfeat.sources.store import materialize, scratch_dir
from sparkfeat.sources.tables import (
    blank_na_tokens,
    infer_types,
    load_loan_table,
    load_table,
    read_csv,
    write_features,
    write_scores,
)

__all__ = [
    "blank_na_tokens",
    "infer_types",
    "load_loan_table",
    "load_table",
    "materialize",
    "read_csv",
    "scratch_dir",
    "write_features",
    "write_scores",
]
