"""Every registered query and the SQL that gives the same rows."""

from weftline.plans import detectors, flows, governance, graphs, records, relational, scanning, search, streams, texts, trust  # noqa: F401
from weftline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
