"""Queries over the input tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldlab.plans import artifacts, audits, datasets, dialogues, extracts, features, ladders, marts, messages, payloads, probability, relational, rosters, scores, training, understanding

_MODULES = (features, artifacts, audits, datasets, scores, relational, messages, marts, probability, ladders, rosters, training, understanding, dialogues, extracts, payloads)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
