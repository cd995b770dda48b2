"""Every registered query. Importing a plan module registers its queries."""

from __future__ import annotations

from tracelode.plans import (  # noqa: F401
    check_plans,
    conversation_plans,
    file_plans,
    graph_plans,
    mining_plans,
    quality_plans,
    record_plans,
    retrieval_plans,
    session_reports,
    streaming_plans,
)
from tracelode.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
