"""All queries over the star-schema tables."""

from . import drillholes, ensembles, models, reports, validation
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "drillholes", "ensembles", "models", "reports", "validation"]
