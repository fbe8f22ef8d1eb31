"""All queries of the library by name."""

from __future__ import annotations

from . import cluster_queries, image_queries, index_queries, io_queries, learn_queries, vector_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
