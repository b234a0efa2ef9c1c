"""Registered queries and their DuckDB twins, side by side."""

from __future__ import annotations

from . import registry
from . import counts, ingest, keys, merge, outputs, search, stories  # noqa: F401

QUERIES = registry.QUERIES
TWINS = registry.TWINS
