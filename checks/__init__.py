"""Queries over the test tables, each with its SQL counterpart."""

from checks import fields, gramming, loading, matching, searching  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
