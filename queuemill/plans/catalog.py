"""All plans by name."""

from queuemill.plans import flagship, kept, measuring, partials, reports, requests, stages, states, streams, verbs  # noqa: F401
from queuemill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
