"""All registered queries and their SQL."""

from __future__ import annotations

from paperlens.plans import grammar, layout, library, papers, passages, reading, sql, streams, texts, translation  # noqa: F401
from paperlens.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
