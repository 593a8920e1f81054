"""All queries of this package, one per operator, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from threadloom.llm import model_queries, native_queries, packing_queries, vector_queries

MODULES = (model_queries, native_queries, packing_queries, vector_queries)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
