"""Edges of a book's sections put together: endpoints by name, and context edges as one first-wins table.

members: book, section, name_key (the normalised name, which is one node of the book), pos (its place in the section),
chunk_id (where the section mentions it; may be null). Sections are ordered by their value. Rows without a
book, section or name take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph as G
from .scratch import Tables

NODE = ["book", "section", "name_key"]


def once_a_section(members: DataFrame) -> DataFrame:
    """Each node once a section, at its first place."""
    known = members.where("book is not null and section is not null and name_key is not null")
    return known.groupBy(*NODE).agg(F.min("pos").alias("pos"), F.min_by("chunk_id", "pos").alias("chunk_id"))


def resolve(drafts: DataFrame, members: DataFrame) -> DataFrame:
    """drafts (book, section, source_name, target_name) with source, target (name_keys), source_at, target_at: section or document.

    A name is looked for among the section's nodes, then among those of the book's sections up to this one. What is
    not found is null.
    """
    own = once_a_section(members).select(*NODE)
    # a name_key's first section says both: whether an earlier one has it, and from where on the book knows it
    known = own.groupBy("book", "name_key").agg(F.min("section").alias("_first"))
    out = drafts
    for end in ("source", "target"):
        out = out.withColumn("name_key", T.normalize_name(F.col(f"{end}_name")))
        here = own.withColumn("_here", F.lit(True))
        out = out.join(here, NODE, "left").join(known, ["book", "name_key"], "left")
        at = F.when(F.col("_here"), "section").when(F.col("_first") <= F.col("section"), "document")
        out = out.withColumn(f"{end}_at", at).withColumn(end, F.when(at.isNotNull(), F.col("name_key"))).drop("name_key", "_here", "_first")
    return out


def resolved_edges(resolved: DataFrame) -> DataFrame:
    """The drafts whose ends are two different nodes."""
    return resolved.where("source is not null and target is not null and source <> target")


def misses(resolved: DataFrame) -> DataFrame:
    """book, n_drafts, n_skipped: drafts that give no edge, as an end is not found or both are one node."""
    skipped = F.col("source").isNull() | F.col("target").isNull() | (F.col("source") == F.col("target"))
    return resolved.groupBy("book").agg(F.count("*").alias("n_drafts"), F.count_if(skipped).alias("n_skipped"))


def _chunk_pairs(own: DataFrame) -> DataFrame:
    """book, section, source, target, raw: neighbours in a chunk, each pair once a section, in the order of chunks by their first node."""
    chunk = Window.partitionBy("book", "section", "chunk_id")
    pairs = own.where("chunk_id is not null").withColumn("_c", F.min("pos").over(chunk)).withColumn("target", F.lead("name_key").over(chunk.orderBy("pos", "name_key")))
    pairs = pairs.where("target is not null").groupBy("book", "section", F.col("name_key").alias("source"), "target").agg(F.min(F.struct("_c", "pos")).alias("_o"))
    return pairs.withColumn("raw", F.row_number().over(Window.partitionBy("book", "section").orderBy("_o", "source", "target"))).drop("_o")


def new_chunk_edges(pairs: DataFrame, cap: int = G.CHUNK_CAP) -> DataFrame:
    """book, section, source, target, raw of pairs that a section adds: its first `cap` among those that no earlier section added.

    Whether a section adds a pair depends on what earlier ones added. A pair whose first pending occurrence is among
    the first `cap` of its section is added there, and its later occurrences are not new; a section with no
    other pending earlier occurrences is settled. Each round settles all such sections at once.
    """
    tables = Tables(pairs.sparkSession)
    key, place = ["book", "source", "target"], ["book", "section"]
    pending = tables.write("pending", pairs.withColumn("room", F.lit(cap)))
    added, turn = None, 0
    while not pending.isEmpty():
        turn += 1
        first = pending.groupBy(*key).agg(F.min("section").alias("_first"))
        ranked = pending.withColumn("_r", F.row_number().over(Window.partitionBy(*place).orderBy("raw"))).join(first, key)
        ranked = tables.write("ranked", ranked.withColumn("_own", F.col("section") == F.col("_first")))
        # up to its first pair that an earlier section may still add, a section's choices are certain
        certain = Window.partitionBy(*place).orderBy("raw").rowsBetween(Window.unboundedPreceding, 0)
        marked = ranked.withColumn("_doubt", F.max(F.when(F.col("_own"), 0).otherwise(1)).over(certain))
        # the room that is left is the cap less what a section has added, so a place within it is sure even after doubtful ones
        marked = marked.withColumn("_sure", F.col("_own") & (F.col("_r") <= F.col("room")))
        marked = tables.write("marked", marked.withColumn("_out", F.col("_own") & (F.col("_doubt") == 0) & (F.col("_r") > F.col("room"))))
        now = tables.write(f"added{turn}", marked.where("_sure").select(*place, "source", "target", "raw"))
        added = now if added is None else added.unionByName(now)
        used = now.groupBy(*place).agg(F.count("*").alias("_used"))
        left = marked.where("not _sure and not _out").join(now.select(*key), key, "left_anti").join(used, place, "left")
        left = left.withColumn("room", F.col("room") - F.coalesce("_used", F.lit(0))).select(pending.columns)
        # a full section adds nothing more
        pending = tables.write("pending", left.where("room > 0"))
    tables.drop("pending", "ranked", "marked")
    return added if added is not None else pairs


def context_edges(members: DataFrame) -> DataFrame:
    """book, source, target, relation, kind, section, confidence: hub, adjacent, chunk and document edges, each key (source, target,
    relation) of a book from the first that makes it, with section edges before those between sections."""
    own = Tables(members.sparkSession).write("members", once_a_section(members))
    several = Window.partitionBy("book", "section")
    ranked = own.withColumn("rn", F.row_number().over(several.orderBy("pos", "name_key"))).withColumn("hub", F.first("name_key").over(several.orderBy("pos", "name_key")))
    ranked = ranked.withColumn("after", F.lead("name_key").over(several.orderBy("pos", "name_key")))
    columns = lambda df, a, b, relation, kind, at, stage: df.select("book", "section", F.col(a).alias("source"), F.col(b).alias("target"), F.lit(relation).alias("relation"), F.lit(kind).alias("kind"), F.lit(G.CONFIDENCE[kind]).alias("confidence"), F.lit(stage).alias("stage"), F.col(at).cast("long").alias("at"))
    hub = columns(ranked.where(F.col("rn").between(2, G.HUB_CAP + 1)), "hub", "name_key", "CONTAINS", "hub", "rn", 0)
    near = columns(ranked.where((F.col("rn") <= G.ADJACENT_CAP) & F.col("after").isNotNull()), "name_key", "after", "PARALLEL_WITH", "adjacent", "rn", 0)
    chunk = columns(new_chunk_edges(_chunk_pairs(own)), "source", "target", "MENTIONED_IN", "chunk", "raw", 0)
    # one row a section: its hub, and that of the section before
    hubs = ranked.where("rn = 1").select("book", "section", "hub").withColumn("was", F.lag("hub").over(Window.partitionBy("book").orderBy("section")))
    between = columns(hubs.where("was is not null and was <> hub").withColumn("at", F.lit(0)), "was", "hub", "PARALLEL_WITH", "section", "at", 1)
    every = hub.unionByName(near).unionByName(chunk).unionByName(between)
    first = every.groupBy("book", "source", "target", "relation").agg(F.min_by(F.struct("kind", "section", "confidence"), F.struct("stage", "section", "at")).alias("e"))
    return first.select("book", "source", "target", "relation", "e.kind", "e.section", "e.confidence")
