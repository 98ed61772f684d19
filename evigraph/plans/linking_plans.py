"""Queries that put the edges of a book's sections together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import linking as L
from .graph_plans import _chunks, _terms
from .tables import table


def context_union(spark: SparkSession, sf: str) -> DataFrame:
    """Context edges of the terms of all documents, with a source as a book; caps count what is new, so it is held against a walk in tests."""
    grounded = G.ground(_terms(spark, sf), _chunks(spark, sf), "doc_id")
    members = grounded.join(table(spark, sf, "documents").select("doc_id", F.col("source").alias("book")), "doc_id")
    return L.context_edges(members.select("book", F.col("doc_id").alias("section"), T.normalize_name(F.col("name")).alias("name_key"), "pos", "chunk_id"))


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders are the sections of a book, their part names its nodes; each line is a draft from its part to the
    next part by number, whose name may be in the order, in an earlier one, or nowhere."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("section"))
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("section"), "l_partkey", "l_linenumber").join(orders, "section")
    named = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    members = named.select("book", "section", T.normalize_name(F.col("p_name")).alias("name_key"), F.col("l_linenumber").alias("pos"), F.lit(None).cast("string").alias("chunk_id"))
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.upper("p_name").alias("target_name"))
    return L.resolve(named.join(following, "p_partkey").select("book", "section", "l_linenumber", "l_partkey", F.col("p_name").alias("source_name"), "target_name"), members)


def endpoint_edges(spark: SparkSession, sf: str) -> DataFrame:
    return L.resolved_edges(_resolved(spark, sf)).select("book", "section", "l_linenumber", "l_partkey", "source", "target", "source_at", "target_at")


def endpoint_misses(spark: SparkSession, sf: str) -> DataFrame:
    return L.misses(_resolved(spark, sf))


QUERIES = {f.__name__: f for f in (context_union, endpoint_edges, endpoint_misses)}

_RESOLVED = """lines AS (SELECT o_custkey AS book, o_orderkey AS section, l_linenumber, l_partkey, p_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
members AS (SELECT DISTINCT book, section, lower(replace(p_name, ' ', '')) AS k FROM lines),
drafts AS (SELECT l.*, lower(replace(l.p_name, ' ', '')) AS source, lower(replace(n.p_name, ' ', '')) AS target FROM lines l JOIN part n ON n.p_partkey = l.l_partkey + 1),
resolved AS (SELECT d.*, CASE WHEN (book, section, target) IN (SELECT (book, section, k) FROM members) THEN 'section' WHEN f.first <= section THEN 'document' END AS target_at
  FROM drafts d LEFT JOIN (SELECT book AS b, k, min(section) AS first FROM members GROUP BY ALL) f ON f.b = d.book AND f.k = d.target)"""

ORACLE_SQL = {
    "endpoint_edges": f"WITH {_RESOLVED} SELECT book, section, l_linenumber, l_partkey, source, target, 'section' AS source_at, target_at FROM resolved WHERE target_at IS NOT NULL AND source <> target",
    "endpoint_misses": f"WITH {_RESOLVED} SELECT book, count(*) AS n_drafts, count(*) FILTER (WHERE target_at IS NULL OR source = target) AS n_skipped FROM resolved GROUP BY book",
}
