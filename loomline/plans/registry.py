"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from loomline.plans import corrections, linkage, pages, records
from loomline.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corrections", "linkage", "pages", "records"]
