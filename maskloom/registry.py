"""All registered queries of the library by name, with their SQL twins."""

from __future__ import annotations

from .plans import artifacts, files, masks, objects, reports, requests, scoring, streams  # noqa: F401
from .plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
