"""All registered queries."""

from __future__ import annotations

import importlib

from .catalog import QUERIES, SQL

for _m in ("score_queries", "answer_queries", "question_queries", "media_queries", "reuse_queries", "source_queries"):
    try:
        importlib.import_module(f"{__name__}.{_m}")
    except ModuleNotFoundError as e:
        if _m not in str(e):
            raise

__all__ = ["QUERIES", "SQL"]
