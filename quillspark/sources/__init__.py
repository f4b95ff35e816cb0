"""Readers, writers and outside models."""

from . import models, readers, writers

__all__ = ["models", "readers", "writers"]
