"""Imports every query module, so that all queries are registered."""

from strokelake.plans import queries_tables  # noqa: F401
from strokelake.plans import queries_labels  # noqa: F401
from strokelake.plans import queries_segments  # noqa: F401
from strokelake.plans import queries_models  # noqa: F401
