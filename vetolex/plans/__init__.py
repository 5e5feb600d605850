"""Named queries over the input tables, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from . import q_builtins, q_corpus, q_experiments, q_grid, q_model, q_scalars, q_stream, q_train  # noqa: F401  (registers queries)
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
