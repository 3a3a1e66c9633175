"""Queries by name; importing this package registers them."""

from quernel.plans import modelling, relational, statistics  # noqa: F401
from quernel.plans.registry import QUERIES, SQL  # noqa: F401
