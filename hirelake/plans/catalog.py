"""All registered queries and oracles of the matching library."""

from __future__ import annotations

from . import feeds, lifecycle, many, pages, places, planning, queries, reports, texts, whole  # noqa: F401

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
