"""Operators for building training data, and their registered queries.

Nothing else in the package imports this folder.
"""

from agentguard.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
