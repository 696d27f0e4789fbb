"""All registered queries."""

from .registry import QUERIES, Query, Tables, query
from . import files, links, mining, ranks, slots, sqlset, structs, synth, texts, windows  # noqa: F401

__all__ = ["QUERIES", "Query", "Tables", "query"]
