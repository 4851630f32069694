"""Every operator bound to the given tables."""

from terrastat.plans import (  # noqa: F401
    balanced_q,
    functions_q,
    joins_q,
    learning_q,
    mixed_q,
    prep_q,
    sources_q,
    spatial_q,
    summary_q,
    windows_q,
)
from terrastat.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
