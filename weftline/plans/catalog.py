"""All registered queries of the library."""

from . import queries_io, queries_jobs, queries_pages, queries_records, queries_relational, queries_state, queries_text  # noqa: F401
from .registry import QUERIES

__all__ = ["QUERIES"]
