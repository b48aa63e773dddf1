"""A query for each operator over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from . import files, indicators, long_series, preparation, reconciliation, signals_returns, sweeps, trades
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "files", "indicators", "long_series", "preparation", "reconciliation", "signals_returns", "sweeps", "trades"]
