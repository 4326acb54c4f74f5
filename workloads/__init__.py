"""Named queries over the driver tables, each with the SQL it must equal."""

from . import align, functions, ingest, models, reports, series, stats
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "align", "functions", "ingest", "models", "reports", "series", "stats"]
