"""Importing this module registers every query."""

from . import (market_queries, model_queries, prepare_queries, rule_queries,
               source_queries, stream_queries)  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
