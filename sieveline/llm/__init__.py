"""Operators for training-data pipelines; nothing else in the library imports them."""

from sieveline.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
