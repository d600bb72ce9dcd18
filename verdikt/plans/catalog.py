"""Importing this module registers every query."""

from verdikt.plans import answers, curating, evaluation, keeping, lines, merging, pairs, ranking, retrieving, texts  # noqa: F401
from verdikt.plans.registry import QUERIES, SQL  # noqa: F401
