"""Integration of books under a character budget: importance, decisions, eviction, allocation, overrides."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ordered import carry
from .scratch import Tables

RATIO, MIN_NEED, MIN_CHARS, FORCE_RETAIN = 0.30, 48, 12, 4.5


def importance(frequency: Column, degree: Column, n_evidence: Column, core: Column, named: Column) -> Column:
    bonus = F.when(core, 1.5).otherwise(0.0) + F.when(named, 1.2).otherwise(0.0)
    return F.round(1.4 * frequency + 1.8 * degree + 0.6 * n_evidence + bonus, 4)


def representative(members: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The first member of each group."""
    return members.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_r = 1").drop("_r")


def budget(total_chars: Column, ratio: float = RATIO) -> Column:
    return F.greatest(F.lit(1), F.floor(total_chars * ratio)).cast("long")


def evict(drafts: DataFrame, limits: DataFrame, group: str, order: list[str], need: str = "need", evictable: str = "evictable") -> DataFrame:
    """drafts with `evicted`: of each group the cheapest evictable drafts go while the need exceeds its limit.

    The order of victims is fixed, so the loop is a running sum: a draft goes if the need that is left
    before it is still over the limit: the sums of the earlier ranges of the order and a running sum
    in its own range. limits: group, limit.
    """
    total = drafts.groupBy(group).agg(F.sum(need).alias("_total"))
    flagged = drafts.withColumn("_last", F.when(F.col(evictable), 0).otherwise(1)).withColumn("_free", F.when(F.col(evictable), F.col(need)).otherwise(0))
    # ranges of the order, written so that they stay as they are; a large group is many of them
    dealt = Tables(drafts.sparkSession).write("dealt", flagged.repartitionByRange(group, "_last", *order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(group, "_range").agg(F.sum("_free").alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy(group, "_range").orderBy("_last", *order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_own", F.coalesce(F.sum("_free").over(own), F.lit(0)))
    # limits go to the few ranges, so that no rows are dealt by group alone
    rows = placed.join(sums.join(total.join(limits, group), group), [group, "_range"])
    out = rows.withColumn("evicted", F.col(evictable) & (F.col("_total") - F.col("_before") - F.col("_own") > F.col("limit")))
    return out.select(*drafts.columns, *[c for c in limits.columns if c not in (group, "limit")], "evicted")


def allocate(drafts: DataFrame, limits: DataFrame, group: str, key: str, weight: str = "importance", length: str = "length", least: int = MIN_CHARS) -> DataFrame:
    """group, key, chars: how many characters each draft of a group may keep, in order of importance.

    Each draft gets its share by weight of what is left, at least `least` and never so much that those
    after it could not have `least`; what it does not use passes on. What is left depends on every
    draft before, so a group's sorted drafts stream through one task, which holds three numbers and
    emits each row; weights are summed up in the same order first.
    """
    types = dict(drafts.dtypes)
    items = drafts.select(
        group, (-F.col(weight)).cast("double").alias("_o"), F.col(key), F.greatest(F.lit(1.0), F.col(weight)).cast("double").alias("_w"), F.col(length).cast("long").alias("_n")
    ).join(limits.select(group, F.col("limit").cast("long").alias("_limit")), group)
    # grouped, as only then the plan has to keep a group's rows together: a map over partitions may read them split
    ordered = lambda df: df.repartition(group).sortWithinPartitions(group, F.asc_nulls_last("_o"), key, "_w", "_n").groupBy(group)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _weights(batches, group)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _shares(batches, group, key, least)

    totals = ordered(items).applyInArrow(weights, f"`{group}` {types[group]}, _weight double, _rest long")
    return ordered(items.join(totals, group)).applyInArrow(shares, f"`{group}` {types[group]}, `{key}` {types[key]}, chars long")


def _weights(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[pa.RecordBatch]:
    """group, _weight, _rest (number of drafts) of the sorted rows of a group."""
    own, weight, n = None, 0.0, 0
    for batch in batches:
        own = batch.column(group).slice(0, 1) if own is None else own
        for w in batch.column("_w").to_pylist():
            weight, n = weight + w, n + 1
    yield pa.RecordBatch.from_arrays([own, pa.array([weight], pa.float64()), pa.array([n], pa.int64())], [group, "_weight", "_rest"])


def _shares(batches: Iterator[pa.RecordBatch], group: str, key: str, least: int) -> Iterator[pa.RecordBatch]:
    """group, key, chars of the sorted rows of a group."""
    left, weight, rest = None, 0.0, 0
    for batch in batches:
        chars = []
        if left is None:
            left, weight, rest = (batch.column(c)[0].as_py() for c in ("_limit", "_weight", "_rest"))
        for w, n in zip(batch.column("_w").to_pylist(), batch.column("_n").to_pylist()):
            rest -= 1
            most = min(max(least, math.floor(left * w / weight)), left - least * rest) if rest else left
            used = max(1, most) if n is None else min(max(1, most), n)
            left, weight = left - used, weight - w
            chars.append(used)
        yield pa.RecordBatch.from_arrays([batch.column(group), batch.column(key), pa.array(chars, pa.int64())], [group, key, "chars"])


def shrink(drafts: DataFrame, limits: DataFrame, group: str, order: list[str], text: str, least: int = MIN_CHARS) -> DataFrame:
    """drafts with their texts cut until each group's characters meet its limit, from the last draft of the order on.

    First no text is cut below `least` characters, then none below one. How much a draft gives is what
    the later ones leave over, that is a sum from the end, carried over ranges of the order. A cut text loses
    its closing marks too, which does not lower what the others have to give in the same pass. limits: group, limit.
    A null text has no characters; groups without a limit are left out. Drafts are told apart by group and order.
    """
    tables = Tables(drafts.sparkSession)
    rows = drafts.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id())
    rows = tables.write("rows", rows)
    limits = limits.select(group, F.col("limit").cast("long").alias("_limit"))
    over = rows.groupBy(group).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("_all")).join(limits, group).select(group, F.greatest(F.lit(0), F.col("_all") - F.col("_limit")).alias("_over"))
    for name, floor in (("first", least), ("second", 1)):
        free = F.greatest(F.lit(0), F.coalesce(F.length(text), F.lit(0)) - floor).cast("long")
        placed = carry(rows.withColumn("_free", free), [group], "_range", order, sums={"_upto": F.col("_free")})
        # the totals meet the ranges, so that no rows are dealt by group alone
        whole = placed.groupBy(group, "_range").agg(F.sum("_free").alias("_part"))
        totals = whole.groupBy(group).agg(F.sum("_part").alias("_sum")).join(over, group)
        ranges = whole.select(group, "_range").join(totals, group)
        gives = F.greatest(F.lit(0), F.least(F.col("_free"), F.col("_over") - (F.col("_sum") - F.col("_upto"))))
        cut = placed.join(ranges, [group, "_range"]).withColumn("_gives", gives)
        done = cut.withColumn(text, F.when(F.col("_gives") > 0, T.truncate(F.col(text), (F.length(text) - F.col("_gives")).cast("int"))).otherwise(F.col(text)))
        rows = tables.write(name, done.select(*drafts.columns, "_range"))
        over = tables.write(f"over_{name}", totals.select(group, F.greatest(F.lit(0), F.col("_over") - F.col("_sum")).alias("_over")))
    tables.drop("rows", "first", "over_first", "over_second")
    return rows.drop("_range")


def compression_stats(decisions: DataFrame, group: str, original: str = "original", retained: str = "retained") -> DataFrame:
    """Counts by action and the share of characters kept of each group."""
    n = lambda a: F.count_if(F.col("action") == a).alias(f"n_{a}")
    kept = F.sum(F.when(F.col("action") == "remove", 0).otherwise(F.col(retained)))
    out = decisions.groupBy(group).agg(*[n(a) for a in ("merge", "refine", "keep", "remove", "conflict")], F.sum(original).alias("original_chars"), kept.alias("retained_chars"))
    return out.withColumn("ratio", F.round(F.col("retained_chars") / F.greatest(F.col("original_chars"), F.lit(1)), 4))


# Decisions are listed by action in this order.
ACTION_ORDER = ("conflict", "refine", "merge", "keep", "remove")


def decide(members: DataFrame, conflicts: DataFrame, evicted: DataFrame) -> DataFrame:
    """unit, action. members: unit, n_books, longest, shortest (definition lengths); conflicts: unit;
    evicted: unit. Units of one book keep unless evicted; others refine if definitions differ much in
    length, else merge."""
    c = conflicts.select("unit", F.lit(True).alias("c")).distinct()
    e = evicted.select("unit", F.lit(True).alias("e")).distinct()
    rows = members.join(c, "unit", "left").join(e, "unit", "left")
    differs = F.col("longest") >= 1.55 * F.greatest(F.col("shortest"), F.lit(1))
    action = F.when(F.col("c"), "conflict").when((F.col("n_books") > 1) & differs, "refine").when(F.col("n_books") > 1, "merge").when(F.col("e"), "remove").otherwise("keep")
    return rows.select("unit", action.alias("action"))


def apply_overrides(decisions: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """decisions with the latest edit of each key: action and confidence are replaced, content only where
    the edit has one. edits: key, seq, action, confidence, content."""
    latest = edits.groupBy(key).agg(F.max_by(F.struct("action", "confidence", "content"), "seq").alias("e"))
    out = decisions.join(latest, key, "left")
    pick = lambda c: F.coalesce(F.col(f"e.{c}"), F.col(c)).alias(c)
    rest = [c for c in decisions.columns if c not in ("action", "confidence", "content")]
    return out.select(*rest, pick("action"), pick("confidence"), pick("content"), F.col("e").isNotNull().alias("edited"))


def upload_progress(parts: DataFrame, sessions: DataFrame, session: str) -> DataFrame:
    """session, received, n_parts, missing, percent. parts: session, idx, size; sessions: session, n_parts."""
    got = parts.groupBy(session).agg(F.sum("size").alias("received"), F.sort_array(F.collect_set("idx")).alias("have"))
    out = sessions.join(got, session, "left").withColumn("have", F.coalesce("have", F.array().cast("array<int>")))
    whole = F.sequence(F.lit(0), F.col("n_parts") - 1)
    missing = F.array_except(whole, F.col("have"))
    return out.select(session, F.coalesce("received", F.lit(0)).alias("received"), "n_parts", missing.alias("missing"), F.floor(100 * (F.col("n_parts") - F.size(missing)) / F.col("n_parts")).cast("int").alias("percent"))
