"""All queries of the engine itself: importing the plans registers them."""

from __future__ import annotations

from sparkfolio.plans import analysis, exports, findings, layouts, paging, readers, reports, searches, store, text  # noqa: F401
from sparkfolio.plans.searches import flagship  # noqa: F401
from sparkfolio.registry import ORACLES, QUERIES, Query, query, table  # noqa: F401
