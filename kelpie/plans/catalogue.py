"""Every registered query of the engine; importing the modules registers them."""

from . import eval_queries, facts_queries, golden_queries, job_queries, retrieval_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
