"""Criterion-based evaluation of texts as Spark DataFrame jobs."""

from verdikt.session import build_session

__all__ = ["build_session"]
