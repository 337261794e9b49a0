"""Queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from specmine.plans import document_cases, layout_cases, manual_cases, record_cases, stream_cases  # noqa: F401
from specmine.plans.case import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
