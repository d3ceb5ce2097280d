"""All registered queries of the library, the llm operators aside."""

from __future__ import annotations

from . import contracts, detection, labelling
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "contracts", "detection", "labelling"]
