"""Operators over a library's state."""
