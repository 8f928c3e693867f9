"""All registered queries, by inventory group."""

from tabsight.plans import eda, features, ingest, insight, models, verbs  # noqa: F401
from tabsight.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
