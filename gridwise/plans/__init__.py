"""Queries of the spatial engine; importing this package registers them."""

from gridwise.plans import aggregates, frames, joins, scalars, stateful, structure  # noqa: F401
from gridwise.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
