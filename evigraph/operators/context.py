"""Edges from the context of concepts, drafts of integration decisions, and views of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph as G
from .scratch import Tables

# Groups of relations as a node's detail shows them, and the order of actions.
GROUPS = {
    "IS_A": "structure", "CAUSES": "causal", "LEADS_TO": "causal", "REFINES": "refine", "APPLIES_TO": "apply", "EXPLAINS": "explain", "EVIDENCED_BY": "explain",
    "MENTIONED_IN": "explain", "CONTRASTS_WITH": "contrast", "CONFLICTS_WITH": "contrast", "PARALLEL_WITH": "refine", "ALIAS_OF": "alias", "SAME_AS": "alias",
}
DIRECTED_GROUPS = {"CONTAINS": ("contains", "structure"), "PART_OF": ("structure", "contains"), "PREREQUISITE_OF": ("structure", "causal")}
ACTIONS = ("conflict", "refine", "merge", "keep", "remove")
# Importance from which a lone concept is kept whatever the budget.
RETAIN_FROM = 4.5
# Patterns of a sentence in which {0} has to be known before {1}; tried both ways round.
BEFORE = (r"{0}.{{0,8}}是{1}.{{0,8}}(基础|前提)", r"(学习|理解|掌握){1}.{{0,20}}{0}.{{0,8}}(基础|前提)", r"{1}.{{0,8}}以{0}.{{0,8}}为(基础|前提)")


def same_chunk_edges(grounded: DataFrame, section: str, cap: int = G.CHUNK_CAP) -> DataFrame:
    """Edges between neighbours (by pos) among the concepts of one chunk, the first `cap` of a section.

    grounded: section, pos, name, chunk_id, each name once a section. Chunks come in the order of their
    first concept.
    """
    chunk = Window.partitionBy(section, "chunk_id")
    pairs = grounded.withColumn("first", F.min("pos").over(chunk)).withColumn("target", F.lead("name").over(chunk.orderBy("pos")))
    pairs = pairs.where("target is not null and target <> name").withColumn("rn", F.row_number().over(Window.partitionBy(section).orderBy("first", "pos")))
    return pairs.where(F.col("rn") <= cap).select(
        section, "chunk_id", F.col("name").alias("source"), "target", F.lit("MENTIONED_IN").alias("relation"), F.lit(G.CONFIDENCE["chunk"]).alias("confidence")
    )


def section_hub_edges(terms: DataFrame, file: str, section: str) -> DataFrame:
    """An edge from the first concept of each section to that of the next section of the file that has one."""
    hubs = terms.groupBy(file, section).agg(F.min_by("name", "pos").alias("target"))
    linked = hubs.withColumn("source", F.lag("target").over(Window.partitionBy(file).orderBy(section)))
    return linked.where("source is not null and source <> target").select(
        file, section, "source", "target", F.lit("PARALLEL_WITH").alias("relation"), F.lit(G.CONFIDENCE["section"]).alias("confidence")
    )


def _before(sentence: Column, first: Column, then: Column, pattern: str) -> Column:
    quoted = lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))
    parts = pattern.replace("{{", "{").replace("}}", "}").replace("{0}", "\x00").replace("{1}", "\x01")
    out, text = [], ""
    for c in parts:
        if c in "\x00\x01":
            out += [F.lit(text), quoted(first if c == "\x00" else then)]
            text = ""
        else:
            text += c
    return F.call_function("rlike", F.regexp_replace(sentence, r"\s+", ""), F.concat(*out, F.lit(text)))


def prerequisite_edges(terms: DataFrame, sentences: DataFrame, markers: tuple[str, ...], section: str) -> DataFrame:
    """One PREREQUISITE_OF edge a section: of the first ordered pair of concepts whose first common
    sentence has a marker, turned the way round that the sentence says.

    terms: section, pos, name; sentences: section, s, sentence. Sections without a marker are left out
    before any pair is made.
    """
    marked = sentences.where(T.contains_any(F.col("sentence"), markers)).select(section).distinct()
    held = terms.join(sentences.join(marked, section, "left_semi"), section).where(F.contains("sentence", F.col("name")))
    held = held.select(section, "s", "sentence", "pos", "name")
    other = held.select(section, "s", F.col("pos").alias("pos2"), F.col("name").alias("name2"))
    pairs = held.join(other, [section, "s"]).where("pos <> pos2 and name <> name2")
    pairs = pairs.groupBy(section, "pos", "pos2").agg(F.min_by(F.struct("name", "name2", "sentence"), "s").alias("p")).select(section, "pos", "pos2", "p.*")
    first = pairs.where(T.contains_any(F.col("sentence"), markers)).groupBy(section).agg(F.min_by(F.struct("name", "name2", "sentence"), F.struct("pos", "pos2")).alias("p"))
    first = first.select(section, "p.*")
    a, b, said = F.col("name"), F.col("name2"), F.col("sentence")
    turned = F.lit(False)
    for pattern in reversed(BEFORE):
        turned = F.when(_before(said, a, b, pattern), False).when(_before(said, b, a, pattern), True).otherwise(turned)
    first = first.withColumn("turned", turned)
    return first.select(
        section, F.when(F.col("turned"), b).otherwise(a).alias("source"), F.when(F.col("turned"), a).otherwise(b).alias("target"),
        F.lit("PREREQUISITE_OF").alias("relation"), T.trim_quote(said, 160).alias("quote"),
    )


def keyword_subgraph(nodes: DataFrame, edges: DataFrame, keyword: str) -> DataFrame:
    """The edges (source, target) between nodes (id, and any texts) that have the keyword, in any case."""
    texts = F.lower(F.concat_ws(" ", *[c for c in nodes.columns if c != "id"]))
    kept = nodes.where(F.contains(texts, F.lit(keyword.strip().lower()))).select("id").distinct()
    for end in ("source", "target"):
        edges = edges.join(kept.withColumnRenamed("id", end), end, "left_semi")
    return edges


def chain_edges(edges: DataFrame, depths: DataFrame) -> DataFrame:
    """start, source, target, depth of the edges whose ends both are reached from start, one step apart at most."""
    end = lambda c, d: depths.select("start", F.col("id").alias(c), F.col("depth").alias(d))
    out = edges.select("source", "target").distinct().join(end("source", "ds"), "source").join(end("target", "dt"), ["start", "target"])
    return out.where(F.abs(F.col("ds") - F.col("dt")) <= 1).select("start", "source", "target", F.greatest("ds", "dt").alias("depth"))


def relation_groups(edges: DataFrame) -> DataFrame:
    """node, grp, n: how many relations of each group a node has, seen from the node."""
    out, back = F.lit("other"), F.lit("other")
    for relation, group in GROUPS.items():
        out, back = (F.when(F.col("relation") == relation, group).otherwise(c) for c in (out, back))
    for relation, (forth, against) in DIRECTED_GROUPS.items():
        out, back = F.when(F.col("relation") == relation, forth).otherwise(out), F.when(F.col("relation") == relation, against).otherwise(back)
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), out.alias("grp")), F.struct(F.col("target").alias("node"), back.alias("grp")))).alias("e"))
    return ends.select("e.*").groupBy("node", "grp").agg(F.count("*").alias("n"))


def section_tree(sections: DataFrame) -> DataFrame:
    """sections (id, parent, seq) with depth (roots 0) and path, the numbers from the root on, by which siblings sort.

    A section whose parent is none of the sections is a root. Levels are joined one by one, each from the
    table of the one above, until one is empty; sections of a circle have no root and are left out.
    """
    tables = Tables(sections.sparkSession)
    ids = sections.select(F.col("id").alias("parent")).distinct()
    seq = F.array(F.col("seq").cast("long"))
    level = tables.write("level0", sections.join(ids, "parent", "left_anti").select("id", F.lit(0).alias("depth"), seq.alias("path")))
    levels = [level]
    while True:
        depth = len(levels)
        above = level.select(F.col("id").alias("parent"), F.col("path").alias("up"))
        level = tables.write(f"level{depth}", sections.join(above, "parent").select("id", F.lit(depth).alias("depth"), F.concat("up", seq).alias("path")))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)


def singleton_drafts(nodes: DataFrame, members: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Keep decisions for the nodes (node_id, importance) that no cluster covers; guarded ones and
    important ones are retained whatever the budget."""
    guarded = conflicts.select("node_id").distinct().withColumn("guarded", F.lit(True))
    alone = nodes.join(members.select("node_id").distinct(), "node_id", "left_anti").join(guarded, "node_id", "left")
    guarded_c = F.coalesce("guarded", F.lit(False))
    return alone.select("node_id", F.lit("keep").alias("action"), "importance", guarded_c.alias("conflict_guarded"), (guarded_c | (F.col("importance") >= RETAIN_FROM)).alias("force_retain"))


def cluster_drafts(members: DataFrame, candidates: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One decision a cluster of two nodes or more: refine if a candidate in it refines, else merge.

    members: cluster, node_id, importance, length (of the definition); candidates: l, r, relation. The
    representative has the longest definition, then the greatest importance, then the least id.
    """
    side = lambda c: members.select(F.col("node_id").alias(c), F.col("cluster").alias(f"{c}_c"))
    refined = candidates.where("relation = 'REFINES'").join(side("l"), "l").join(side("r"), "r").where("l_c = r_c").select(F.col("l_c").alias("cluster")).distinct()
    guarded = conflicts.select("node_id").distinct().withColumn("guarded", F.lit(True))
    best = F.max_by("node_id", F.struct("length", "importance", -F.col("node_id")))
    drafts = members.join(guarded, "node_id", "left").groupBy("cluster").agg(
        F.count("*").alias("n_members"), best.alias("representative"), F.round(F.sum("importance"), 4).alias("importance"),
        F.coalesce(F.bool_or("guarded"), F.lit(False)).alias("force_retain"),
    )
    drafts = drafts.where("n_members > 1").join(refined.withColumn("refined", F.lit(True)), "cluster", "left")
    return drafts.select("cluster", F.when(F.col("refined"), "refine").otherwise("merge").alias("action"), "representative", "n_members", "importance", "force_retain")


def sort_decisions(decisions: DataFrame) -> DataFrame:
    """decisions (action, cluster, id) in their order, with action_order."""
    order = F.lit(len(ACTIONS))
    for i, a in enumerate(ACTIONS):
        order = F.when(F.col("action") == a, i).otherwise(order)
    return decisions.withColumn("action_order", order).orderBy("action_order", F.coalesce(F.col("cluster").cast("string"), F.lit("")), "id")


def alias_relations(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """cluster, relation: ALIAS_OF if any candidate inside says so, then REFINES, else SAME_AS."""
    side = lambda c: members.select(F.col("node_id").alias(c), F.col("cluster").alias(f"{c}_c"))
    inside = candidates.join(side("l"), "l").join(side("r"), "r").where("l_c = r_c").groupBy(F.col("l_c").alias("cluster"))
    said = inside.agg(F.bool_or(F.col("relation") == "ALIAS_OF").alias("alias"), F.bool_or(F.col("relation") == "REFINES").alias("refines"))
    out = members.select("cluster").distinct().join(said, "cluster", "left")
    return out.select("cluster", F.when(F.col("alias"), "ALIAS_OF").when(F.col("refines"), "REFINES").otherwise("SAME_AS").alias("relation"))


def readiness(items: DataFrame, done: DataFrame, group: str, key: str) -> DataFrame:
    """group, n, n_missing, ready: whether every key of a group is among those done."""
    have = done.select(key).distinct().withColumn("_have", F.lit(1))
    out = items.join(have, key, "left").groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col("_have").isNull()).alias("n_missing"))
    return out.withColumn("ready", F.col("n_missing") == 0)


def clean_text(text: Column) -> Column:
    """One kind of line end and space, no blank lines, single spaces."""
    out = F.regexp_replace(F.regexp_replace(text, "﻿", ""), "\r\n?", "\n")
    lines = F.transform(F.split(out, "\n", -1), lambda x: F.btrim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def aliases_from_text(text: Column) -> Column:
    """Latin phrases in parentheses, then Latin phrases anywhere, as alias keys, first seen first."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit(r"[(（]([A-Za-z][A-Za-z\s\-]{1,40})[)）]"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"\b[A-Za-z][A-Za-z\s\-]{2,40}\b"), F.lit(0))
    )
    keys = F.transform(found, lambda x: T.normalize_term(x))
    return F.array_distinct(F.filter(keys, lambda x: x != ""))
