"""Sources: loan exports, catalog documents, reports."""

from .documents import (
    DocumentClient, read_approvals, read_author_works, read_editions, read_editions_from, read_names, read_report, read_search, read_volumes, read_works, read_works_from,
)
from .loans import newest, read_loans

__all__ = [
    "DocumentClient", "newest", "read_approvals", "read_author_works", "read_editions", "read_editions_from", "read_loans", "read_names", "read_report", "read_search",
    "read_volumes", "read_works", "read_works_from",
]
