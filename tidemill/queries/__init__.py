"""Every operator as a query over the driver's tables, most with SQL that gives the same rows."""

from . import extras, metrics, pipelines, scans, searches, services, stored
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "extras", "metrics", "pipelines", "scans", "searches", "services", "stored"]
