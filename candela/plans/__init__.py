"""Registered queries."""

from candela.plans import registry
from candela.plans import agent_queries, data_queries  # register more

__all__ = ["agent_queries", "data_queries", "registry"]
