"""The registered queries of this subpackage and the SQL for the same rows."""

from __future__ import annotations

from vanewatch.llm import (  # noqa: F401
    q_benchmark,
    q_bpe,
    q_chat,
    q_divergence,
    q_html,
    q_language,
    q_lines,
    q_mixing,
    q_quality,
    q_repeats,
    q_resampling,
    q_signatures,
)
from vanewatch.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
