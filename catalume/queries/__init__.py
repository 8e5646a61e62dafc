"""The registered queries of the library proper."""

from __future__ import annotations

from catalume.queries import decisions, foldings, identities, matching, reads, scalars, upkeep, windows, writes  # noqa: F401  (they register themselves)
from catalume.queries.registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "fuzzy_match"
