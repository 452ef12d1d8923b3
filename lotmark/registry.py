"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from lotmark.plans import branches, details, grammars, history, intake, judging, pages, patterns, reconciling, records, relations, reviewing, routes, rowfilters, scoring, shifting, snapshots, streams, text, trees  # noqa: F401  they register their queries
from lotmark.plans.base import ORACLE, QUERIES

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
FLAGSHIP = "a03_buyer_top_bidders"
