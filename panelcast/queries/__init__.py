"""Every operator as a query over the star-schema tables, with its SQL check."""

import panelcast
from panelcast.queries import evaluate, history, models, prepare, profile  # noqa: F401
from panelcast.queries.registry import CHECKS, QUERIES

# The driver of these queries may run where executors have no copy of the package.
panelcast.ship_by_value()

__all__ = ["CHECKS", "QUERIES"]
