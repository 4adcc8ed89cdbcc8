"""All registered queries and their SQL, by name."""

from __future__ import annotations

from intervane.plans import alignment, matching, past, registry, resolving, signals, sync  # noqa: F401  registers their queries

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
