"""All queries of the library and their SQL twins."""

from __future__ import annotations

from . import q_activity, q_harness, q_layout, q_links, q_quality, q_retrieval, q_routing, q_segment, q_store  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
