"""Incremental use of the same operators with Structured Streaming: additions to the batch interface."""

from .feedback import feedback_rows, latest_rows, stream_feedback
from .feeds import latest_feedback, stream_loans

__all__ = ["feedback_rows", "latest_feedback", "latest_rows", "stream_feedback", "stream_loans"]
