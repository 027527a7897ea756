"""Every registered query with the SQL that must give the same rows."""

from metricloom.catalog.base import CATALOG
from metricloom.catalog import breakdowns, explorer, kpis, quality, series  # noqa: F401  (they register queries)

__all__ = ["CATALOG"]
