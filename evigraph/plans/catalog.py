"""Every registered query of the library, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import book_plans, concept_plans, context_plans, edit_plans, graph_plans, linking_plans, merge_plans, question_plans, text_plans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (text_plans, graph_plans, merge_plans, context_plans, book_plans, question_plans, edit_plans, linking_plans, concept_plans):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
