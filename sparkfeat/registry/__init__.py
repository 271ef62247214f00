"""Registered queries: every operator run over whole tables, with the SQL that checks it."""

from sparkfeat.registry.base import ORACLES, QUERIES
from sparkfeat.registry import (  # noqa: F401  (importing registers the queries)
    scalars,
    aggregates,
    rows,
    encoding,
    sampling,
    models,
    stored,
    composites,
)

__all__ = ["ORACLES", "QUERIES"]
