"""Structured Streaming adapters for the stateless cleaning expressions."""

from .clean_stream import clean_stream, cleaned_stream  # noqa: F401
