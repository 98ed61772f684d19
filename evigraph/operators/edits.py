"""A teacher's edits as state: overrides read from dialogue, replayed over decisions with before images, and what they do to concepts and totals.

decisions: decision_id, action, content, confidence; edits: seq (a number that orders them), decision_id, action, content
(null keeps what stands), confidence, reason. Edits of decisions that do not exist have no effect and are not replayed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon
from .ask import action_of
from .ordered import carry
from .scratch import Tables

DECISION_ID = "integration_decision_[A-Za-z0-9_]+"
# What an override says of itself and of a concept.
REASON = "教师覆盖："
REMOVED, REWRITTEN = "教师标记为移出整合正文。", "教师覆盖后的整合表述。"


def overrides(messages: DataFrame, pack: Lexicon) -> DataFrame:
    """The messages that override a decision, as edits.

    messages: seq, message, target (a decision, or null), action (or null), content, confidence, reason (or null). What a
    message does not give is looked for in its text; without a decision or an action it is only feedback.
    """
    target = F.coalesce("target", F.nullif(F.regexp_extract("message", DECISION_ID, 0), F.lit("")))
    out = messages.select("seq", target.alias("decision_id"), F.coalesce("action", action_of(F.col("message"), pack)).alias("action"), "content", "confidence", F.coalesce("reason", "message").alias("reason"))
    return out.where("decision_id is not null and action is not null")


def replay(decisions: DataFrame, edits: DataFrame) -> DataFrame:
    """Each edit with the state before and after it: seq, decision_id, action, content, confidence, reason, before_action,
    before_content, before_confidence.

    A decision's edits may be any share of all: they are dealt by ranges of seq and the state is carried over.
    """
    known = edits.join(decisions.select("decision_id", F.col("action").alias("a0"), F.col("content").alias("c0"), F.col("confidence").alias("f0")), "decision_id")
    ranged = known.repartitionByRange("decision_id", "seq").withColumn("_range", F.spark_partition_id())
    ranged = Tables(edits.sparkSession).write("edits", ranged)
    out = carry(ranged, ["decision_id"], "_range", ["seq"], lasts={"_a": F.col("action"), "_c": F.col("content"), "_f": F.col("confidence")})
    before = F.coalesce("_c", "c0")
    return out.select(
        "seq", "decision_id", "action", F.coalesce("content", before).alias("content"), "confidence", F.concat(F.lit(REASON), "reason").alias("reason"),
        F.coalesce("_a", "a0").alias("before_action"), before.alias("before_content"), F.coalesce("_f", "f0").alias("before_confidence"),
    )


def applied(decisions: DataFrame, replayed: DataFrame) -> DataFrame:
    """decisions as they stand after all edits, with original_action, n_edits and last_seq (null where there is none)."""
    last = replayed.groupBy("decision_id").agg(F.max_by(F.struct("action", "content", "confidence"), "seq").alias("e"), F.count("*").alias("n_edits"), F.max("seq").alias("last_seq"))
    out = decisions.join(last, "decision_id", "left")
    return out.select(
        "decision_id", F.coalesce("e.action", "action").alias("action"), F.when(F.col("e").isNotNull(), F.col("e.content")).otherwise(F.col("content")).alias("content"),
        F.coalesce("e.confidence", "confidence").alias("confidence"), F.when(F.col("e").isNotNull(), F.col("action")).alias("original_action"),
        F.coalesce("n_edits", F.lit(0)).alias("n_edits"), "last_seq",
    )


def edited_concepts(concepts: DataFrame, replayed: DataFrame) -> DataFrame:
    """concepts (concept_id, definition, summary, decision_ids) after all edits, with teacher_action and last_seq.

    The last edit with content that does not remove gives the definition; of these and removals the last gives the summary.
    """
    of = concepts.select("concept_id", F.explode("decision_ids").alias("decision_id")).distinct().join(replayed, "decision_id")
    writes = (F.col("action") != "remove") & (F.coalesce(F.length("content"), F.lit(0)) > 0)
    says = F.when(F.col("action") == "remove", REMOVED).when(writes, REWRITTEN)
    last = lambda value, when: F.max_by(value, F.when(when, F.col("seq")))
    met = of.groupBy("concept_id").agg(last(F.col("content"), writes).alias("_d"), last(says, says.isNotNull()).alias("_s"), F.max_by("action", "seq").alias("teacher_action"), F.max("seq").alias("last_seq"))
    out = concepts.join(met, "concept_id", "left")
    return out.select("concept_id", F.coalesce("_d", "definition").alias("definition"), F.coalesce("_s", "summary").alias("summary"), "teacher_action", "last_seq")


def recalculated(decisions: DataFrame, existing: DataFrame, group: str) -> DataFrame:
    """group, retained, n_<action>, ratio: totals over decisions after edits. existing: group, original, retained (kept where no text stands)."""
    n = lambda a: F.count_if(F.col("action") == a).alias(f"n_{a}")
    kept = F.coalesce(F.sum(F.when(F.col("action") != "remove", F.length("content"))), F.lit(0))
    own = decisions.groupBy(group).agg(kept.alias("kept"), *[n(a) for a in ("merge", "refine", "keep", "remove", "conflict")])
    out = own.join(existing, group).withColumn("retained", F.when(F.col("kept") > 0, F.col("kept")).otherwise(F.col("retained")))
    ratio = F.when(F.col("original") > 0, F.round(F.col("retained") / F.col("original"), 4)).otherwise(0.0)
    return out.withColumn("ratio", ratio).drop("kept", "original")


STATE = "action string, content string, confidence double"
REPLAYED = "seq long, decision_id string, action string, content string, confidence double, reason string, before_action string, before_content string, before_confidence double"


def replay_stream(edits: DataFrame) -> DataFrame:
    """A stream of edits (with a0, c0, f0, the decision's own state) as `replay` gives them: the state of each decision is kept between batches.

    Edits of one batch are put in order of seq; later batches must bring later edits.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        now = state.get if state.exists else None
        out = []
        for r in rows.itertuples():
            action, content, confidence = now or (r.a0, r.c0, r.f0)
            now = (r.action, r.content if isinstance(r.content, str) else content, r.confidence)
            out.append((r.seq, key[0], *now, REASON + r.reason, action, content, confidence))
        state.update(now)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in REPLAYED.split(", ")])

    return edits.groupBy("decision_id").applyInPandasWithState(step, REPLAYED, STATE, "append", "NoTimeout")
