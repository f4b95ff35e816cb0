"""Streaming forms of the document transforms."""

from . import landing

__all__ = ["landing"]
