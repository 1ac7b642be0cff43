"""Registered queries for the engine's own operators, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from umbra.plans import datasets, detection, evaluation
from umbra.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "datasets", "detection", "evaluation"]
