"""Importing this module registers every query outside the llm subpackage."""

from epochlane.plans import completing, learning, predicting, profiling, searching, staging, windowing  # noqa: F401
from epochlane.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
