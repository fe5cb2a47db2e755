"""Whole queries over the driver's tables, each with its SQL."""

from trajlake.plans import commits, contents, rollouts, survey, texts, vectors  # noqa: F401
from trajlake.plans.registry import QUERIES, SQL  # noqa: F401
