"""Imports every query module, so that the registry is complete."""

from crowdlens.catalog import (  # noqa: F401
    ingest_queries,
    label_queries,
    metric_queries,
    model_queries,
    signal_queries,
    stream_queries,
    text_queries,
)
from crowdlens.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
