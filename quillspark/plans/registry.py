"""All registered queries of the library proper, and their SQL."""

from quillspark.plans import data, features, metrics, models, more, prepare, tabular
from quillspark.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "data", "features", "metrics", "models", "more", "prepare", "tabular"]
