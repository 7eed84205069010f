"""Imports every module that registers queries."""

from weftload.plans import (  # noqa: F401
    analysis_queries,
    generation_queries,
    monitoring_queries,
    statement_queries,
    streaming_queries,
)
