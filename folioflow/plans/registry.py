"""All registered queries of the library and their SQL, by name."""

from . import corpus, evaluation, grading, packages, profiling, sampling, scoring, statistics, storage, structure  # noqa: F401  they register themselves
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
