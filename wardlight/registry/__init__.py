"""All registered queries."""

from wardlight.registry import (  # noqa: F401
    sources_q,
    projections_q,
    findings_q,
    secrets_q,
    facts_q,
    graph_q,
    web_q,
    triage_q,
    streaming_q,
    plans_q,
)
from wardlight.registry.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
