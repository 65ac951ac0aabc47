"""All registered queries."""

from tideline.queries import alerts, analysis, graph, lake, models, prices, streams  # noqa: F401
from tideline.queries.registry import REGISTERED

__all__ = ["REGISTERED"]
