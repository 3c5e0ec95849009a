"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from corpuslake.plans import more, places, records, relational, shapes, states, text_search, views  # noqa: F401  (they register their queries)

QUERIES = views.QUERIES
ORACLES = views.ORACLES
