"""Registered queries with their SQL."""

from . import more, papers, queries  # noqa: F401
