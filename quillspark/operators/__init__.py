"""Operators over DataFrames."""

from . import anonymise, classify, clean, evaluate, extract, lines, neighbours, ranking, render, sampling

__all__ = ["anonymise", "classify", "clean", "evaluate", "extract", "lines", "neighbours", "ranking", "render", "sampling"]
