"""All registered queries of the core."""

from __future__ import annotations

from . import corpus, vectors, vocabulary  # noqa: F401  (they register)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
