"""Queries by name with their SQL, collected from the modules of this folder."""

from __future__ import annotations

from . import account_queries, frame_queries, function_queries, graph_queries, group_queries, mosaic_queries, network_queries, noding_queries, replay_queries, sequence_queries, set_queries, source_queries, spatial_queries, stream_queries, text_queries, trail_queries
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "account_queries", "frame_queries", "function_queries", "graph_queries", "group_queries", "mosaic_queries", "network_queries", "noding_queries", "replay_queries", "sequence_queries", "set_queries", "source_queries", "spatial_queries", "stream_queries", "text_queries", "trail_queries"]
