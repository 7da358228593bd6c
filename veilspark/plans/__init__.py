"""Registered queries and their oracles."""

from . import detection, nested, redaction, sources  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
