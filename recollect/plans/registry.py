"""All queries of the core and their SQL equivalents."""

from __future__ import annotations

from recollect.plans import nested_queries, operator_queries, queries  # noqa: F401 - the second registers with the third

QUERIES = {**queries.QUERIES, **nested_queries.QUERIES}
ORACLES = dict(queries.ORACLES)
FLAGSHIP = queries.FLAGSHIP
