"""Loads every query of this package and the pipeline."""

from importlib import import_module

import corpus_pipeline
from quarte.llm import registry

MODULES = (
    "quality_queries", "jaccard_queries", "repeat_queries", "token_queries", "page_queries", "vector_queries",
    "score_queries", "audit_queries", "search_queries", "secret_queries",
)


def load():
    for module in MODULES:
        import_module(f"quarte.llm.{module}")
    registry.QUERIES.setdefault("pipeline", corpus_pipeline.run)
    if corpus_pipeline.ORACLE_SQL:
        registry.ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
    return registry
