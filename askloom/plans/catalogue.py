"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from askloom.plans import answer_queries, corpus_queries, retrieval_queries, stream_queries, usage_queries  # noqa: F401
from askloom.plans.registry import ORACLES, QUERIES  # noqa: F401
