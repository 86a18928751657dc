"""Named queries over the standard tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import box_queries, event_queries, flow_queries, markup_queries, shape_queries, text_queries

_PARTS = (text_queries, shape_queries, box_queries, event_queries, flow_queries, markup_queries)
QUERIES = {k: q for part in _PARTS for k, q in part.QUERIES.items()}
ORACLES = {k: sql for part in _PARTS for k, sql in part.ORACLES.items()}
