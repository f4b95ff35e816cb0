"""Column expressions of the library."""

from . import calls, fixed, numbers, privacy, text

__all__ = ["calls", "fixed", "numbers", "privacy", "text"]
