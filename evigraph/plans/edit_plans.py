"""Queries on edits: each event is a message about a decision on its user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import LATIN
from ..operators import edits as E
from ..operators.context import ACTIONS
from .tables import table


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    """One decision for each customer."""
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf, "customer").select(F.concat(F.lit("integration_decision_"), F.col("c_custkey").cast("string")).alias("decision_id"), action.alias("action"),
        F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("content"), F.round(F.col("c_acctbal") / 10000, 4).alias("confidence"), "c_mktsegment")


def _edits(spark: SparkSession, sf: str) -> DataFrame:
    """Errors drop, clicks keep, purchases merge what they name; others say nothing, and views name no decision."""
    said = F.when(F.col("event_type") == "error", "drop ").when(F.col("event_type") == "click", "keep ").when(F.col("event_type") == "purchase", "merge ").otherwise("see ")
    named = F.concat(F.lit("integration_decision_"), F.col("user_id").cast("string"))
    message = F.concat(said, F.when(F.col("event_type") == "view", "all").when(F.col("event_id") % 4 == 0, "it").otherwise(named))
    none = F.lit(None).cast("string")
    messages = table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), message.alias("message"), F.when(F.col("event_id") % 4 == 0, named).alias("target"), none.alias("action"),
        F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("content"), (F.col("value") / 1000).alias("confidence"), none.alias("reason"),
    )
    return E.overrides(messages, LATIN)


def _replayed(spark: SparkSession, sf: str) -> DataFrame:
    return E.replay(_decisions(spark, sf), _edits(spark, sf))


def edit_replay(spark: SparkSession, sf: str) -> DataFrame:
    return _replayed(spark, sf)


def edited_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return E.applied(_decisions(spark, sf), _replayed(spark, sf))


def edited_concepts(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation is a concept of the decisions on its customers."""
    named = F.concat(F.lit("integration_decision_"), F.col("c_custkey").cast("string"))
    of = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("concept_id")).agg(F.collect_set(named).alias("decision_ids"))
    concepts = of.select("concept_id", F.lit("own").alias("definition"), F.lit("none").alias("summary"), "decision_ids")
    return E.edited_concepts(concepts, _replayed(spark, sf))


def edited_stats(spark: SparkSession, sf: str) -> DataFrame:
    decisions = _decisions(spark, sf)
    now = E.applied(decisions, _replayed(spark, sf)).join(decisions.select("decision_id", "c_mktsegment"), "decision_id")
    existing = decisions.groupBy("c_mktsegment").agg((F.count("*") * 40).alias("original"), F.lit(7).cast("long").alias("retained"))
    return E.recalculated(now, existing, "c_mktsegment")


QUERIES = {f.__name__: f for f in (edit_replay, edited_decisions, edited_concepts, edited_stats)}

_ACTION = "CASE c_custkey % 5 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ACTIONS)) + " END"
_LAST = "last_value({} IGNORE NULLS) OVER (PARTITION BY decision_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_REPLAYED = f"""d AS (SELECT 'integration_decision_' || c_custkey AS decision_id, {_ACTION} AS action, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS content, round(c_acctbal / 10000, 4) AS confidence, c_mktsegment, c_nationkey FROM customer),
m AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'drop ' WHEN 'click' THEN 'keep ' WHEN 'purchase' THEN 'merge ' ELSE 'see ' END AS said, 'integration_decision_' || user_id AS named, event_type, event_id, value, props FROM events),
e AS (SELECT seq, named AS decision_id, CASE said WHEN 'drop ' THEN 'remove' WHEN 'keep ' THEN 'keep' ELSE 'merge' END AS action, CASE WHEN event_id % 3 = 0 THEN props END AS content, value / 1000 AS confidence,
  said || CASE WHEN event_type = 'view' THEN 'all' WHEN event_id % 4 = 0 THEN 'it' ELSE named END AS reason FROM m WHERE said <> 'see '),
p AS (SELECT e.*, d.action AS a0, d.content AS c0, d.confidence AS f0 FROM e JOIN d USING (decision_id)),
replayed AS (SELECT seq, decision_id, action, coalesce(content, {_LAST.format('content')}, c0) AS content, confidence, '{E.REASON}' || reason AS reason,
  coalesce({_LAST.format('action')}, a0) AS before_action, coalesce({_LAST.format('content')}, c0) AS before_content, coalesce({_LAST.format('confidence')}, f0) AS before_confidence FROM p)"""
_APPLIED = f"""{_REPLAYED}, fin AS (SELECT decision_id, last(action ORDER BY seq) AS a, last(content ORDER BY seq) AS c, last(confidence ORDER BY seq) AS f, count(*) AS n_edits, max(seq) AS last_seq FROM replayed GROUP BY decision_id),
applied AS (SELECT d.decision_id, coalesce(a, action) AS action, CASE WHEN a IS NULL THEN content ELSE c END AS content, coalesce(f, confidence) AS confidence, CASE WHEN a IS NOT NULL THEN action END AS original_action, coalesce(n_edits, 0) AS n_edits, last_seq, c_mktsegment
  FROM d LEFT JOIN fin USING (decision_id))"""

ORACLE_SQL = {
    "edit_replay": f"WITH {_REPLAYED} SELECT * FROM replayed",
    "edited_decisions": f"WITH {_APPLIED} SELECT * EXCLUDE (c_mktsegment) FROM applied",
    "edited_concepts": f"""WITH {_REPLAYED}, c AS (SELECT c_nationkey AS concept_id, r.* FROM replayed r JOIN d USING (decision_id)),
x AS (SELECT concept_id, last(content ORDER BY seq) FILTER (WHERE action <> 'remove' AND length(content) > 0) AS t, last(CASE WHEN action = 'remove' THEN '{E.REMOVED}' ELSE '{E.REWRITTEN}' END ORDER BY seq) FILTER (WHERE action = 'remove' OR length(content) > 0) AS s,
  last(action ORDER BY seq) AS teacher_action, max(seq) AS last_seq FROM c GROUP BY concept_id)
SELECT concept_id, coalesce(t, 'own') AS definition, coalesce(s, 'none') AS summary, teacher_action, last_seq FROM (SELECT DISTINCT c_nationkey AS concept_id FROM customer) LEFT JOIN x USING (concept_id)""",
    "edited_stats": f"""WITH {_APPLIED}, t AS (SELECT c_mktsegment, coalesce(sum(length(content)) FILTER (WHERE action <> 'remove'), 0) AS kept, count(*) * 40 AS original,
  {', '.join(f"count(*) FILTER (WHERE action = '{a}') AS n_{a}" for a in ('merge', 'refine', 'keep', 'remove', 'conflict'))} FROM applied GROUP BY c_mktsegment)
SELECT c_mktsegment, n_merge, n_refine, n_keep, n_remove, n_conflict, CAST(CASE WHEN kept > 0 THEN kept ELSE 7 END AS BIGINT) AS retained, round(CASE WHEN kept > 0 THEN kept ELSE 7 END / original, 4) AS ratio FROM t""",
}
