"""The knowledge graph: term extraction, grounding, merging, context edges, layers and traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import Lexicon
from .scratch import Tables

HUB_CAP, ADJACENT_CAP, CHUNK_CAP = 8, 10, 8
CONFIDENCE = {"node": 0.62, "edge": 0.55, "hub": 0.48, "adjacent": 0.46, "chunk": 0.50, "section": 0.38}
# Traversable relations by priority.
PATH_PRIORITY = ("PREREQUISITE_OF", "CAUSES", "LEADS_TO", "EXPLAINS", "APPLIES_TO", "PART_OF", "IS_A", "CONTRASTS_WITH", "CONTAINS")


def clean_term(term: Column) -> Column:
    out = T.collapse(term)
    out = F.regexp_replace(out, r"^[第\d一二三四五六七八九十百章节篇、\s.．]+", "")
    # each step names its input once, so the expression stays linear
    for marker in ("被称为", "称为", "叫做"):
        out = F.regexp_replace(out, rf"^(?!.*{marker}$).*{marker}\s*", "")
    for prefix in ("但严重者可导致", "严重者可导致", "可导致", "导致", "中的", "也与"):
        out = F.regexp_replace(out, rf"^{prefix}\s*", "")
    return F.regexp_replace(out, r"""^[ ：:，,。；;（）()\[\]【】"']+|[ ：:，,。；;（）()\[\]【】"']+$""", "")


def good_term(name: Column, pack: Lexicon) -> Column:
    """Whether a cleaned term may name a concept."""
    starts = F.lit(False)
    for p in pack.bad_prefixes:
        starts = starts | F.startswith(name, F.lit(p))
    ends = F.lit(False)
    for p in pack.bad_endings:
        ends = ends | F.endswith(name, F.lit(p))
    n = F.length(name)
    long_ok = (n <= 18) | name.rlike("[A-Za-z]")
    particles = (n - F.length(F.replace(name, F.lit(pack.particle), F.lit("")))) / len(pack.particle)
    sentence_like = ((n > 8) & T.contains_any(name, pack.bad_verbs)) | ((n > 10) & (particles >= 2))
    return (
        n.between(2, 40) & ~name.rlike(r"^\d{1,4}$") & ~starts & ~ends & ~T.contains_any(name, pack.bad_fragments) & ~sentence_like
        & ~name.rlike("[。！？；;，,]") & long_ok & name.rlike("[\\u4e00-\\u9fffA-Za-z]")
    )


def candidate_terms(title: Column, text: Column, pack: Lexicon, limit: int) -> Column:
    """Title first, then the matches of each pattern in turn; cleaned, filtered, first seen first."""
    found = [F.array(title)]
    for p in pack.term_patterns:
        group = 1 if "(" in p.replace("(?:", "") else 0
        found.append(F.regexp_extract_all(text, F.lit(p), F.lit(group)))
    cleaned = F.transform(F.filter(F.concat(*found), lambda x: x.isNotNull()), clean_term)
    return F.slice(F.array_distinct(F.filter(cleaned, lambda x: good_term(x, pack))), 1, limit)


def section_terms(sections: DataFrame, pack: Lexicon, limit: int = 12, key: str = "section_id", text: str = "content", title: str = "title") -> DataFrame:
    """key, pos (from 0), name of the terms of each section."""
    terms = sections.select(key, F.posexplode(candidate_terms(F.col(title), F.col(text), pack, limit)).alias("pos", "name"))
    return terms


def ground(terms: DataFrame, chunks: DataFrame, section: str = "section_id", chunk: str = "chunk_id", text: str = "chunk") -> DataFrame:
    """section, pos, name, chunk_id, quote, strategy: the first sentence, by chunk and place, that has the
    term; a term that no sentence has falls back to the first chunk, unverified."""
    said = chunks.select(section, chunk, F.col("chunk_no"), F.posexplode(T.sentences(F.col(text))).alias("s", "sentence"))
    met = terms.join(said, section).where(F.contains("sentence", F.col("name")))
    best = met.groupBy(section, "pos").agg(F.min_by(F.struct(F.col(chunk), F.col("sentence")), F.struct("chunk_no", "s")).alias("b"))
    best = best.select(section, "pos", F.col(f"b.{chunk}").alias(chunk), T.trim_quote(F.col("b.sentence"), 160).alias("quote"))
    start = chunks.groupBy(section).agg(F.min_by(F.struct(F.col(chunk), F.col(text)), "chunk_no").alias("c0"))
    out = terms.join(best, [section, "pos"], "left").join(start, section)
    return out.select(
        section, "pos", "name", F.coalesce(chunk, F.col(f"c0.{chunk}")).alias(chunk), F.coalesce("quote", T.trim_quote(F.col(f"c0.{text}"), 160)).alias("quote"),
        F.when(F.col("quote").isNotNull(), "term_sentence").otherwise("fallback_first_chunk").alias("strategy"),
    )


def merge_nodes(drafts: DataFrame, book: str, name: str, seq: str, evidence: str, confidence: str | None = None) -> DataFrame:
    """One node for each book and normalised name: the first draft's name, how many drafts, the distinct
    evidence in order, the highest confidence."""
    keyed = drafts.withColumn("name_key", T.normalize_name(F.col(name)))
    ordered = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(evidence).alias("e")))), lambda x: x["e"]))
    best = F.max(confidence) if confidence else F.lit(CONFIDENCE["node"])
    return keyed.groupBy(book, "name_key").agg(
        F.min_by(name, seq).alias("name"), F.count("*").alias("frequency"), ordered.alias("evidence"), best.alias("confidence")
    )


def first_wins(edges: DataFrame, keys: list[str], seq: list[str | Column]) -> DataFrame:
    """The first edge of each key in the given order."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*seq))
    return edges.withColumn("_r", r).where("_r = 1").drop("_r")


def hub_edges(items: DataFrame, group: str, order: str, node: str, cap: int = HUB_CAP) -> DataFrame:
    """The first node of each group contains each of the next `cap`."""
    w = Window.partitionBy(group).orderBy(order)
    ranked = items.withColumn("rn", F.row_number().over(w)).withColumn("hub", F.first(node).over(w))
    return ranked.where(F.col("rn").between(2, cap + 1)).select(group, F.col("hub").alias("source"), F.col(node).alias("target"), F.lit("CONTAINS").alias("relation"), F.lit(CONFIDENCE["hub"]).alias("confidence"))


def adjacent_edges(items: DataFrame, group: str, order: list[str], node: str, relation: str, confidence: float, cap: int | None = None) -> DataFrame:
    """Each node and the next one of its group; at most `cap` of a group."""
    w = Window.partitionBy(group).orderBy(*order)
    pairs = items.withColumn("rn", F.row_number().over(w)).withColumn("target", F.lead(node).over(w)).where("target is not null")
    pairs = pairs.where(F.col("rn") <= cap) if cap else pairs
    return pairs.where(F.col(node) != F.col("target")).select(group, F.col(node).alias("source"), "target", F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"))


def sequence_edges(items: DataFrame, group: str, order: list[str], node: str) -> DataFrame:
    """NEXT and PREVIOUS edges between neighbours of a group."""
    forth = adjacent_edges(items, group, order, node, "NEXT", 1.0)
    back = forth.select(group, F.col("target").alias("source"), F.col("source").alias("target"), F.lit("PREVIOUS").alias("relation"), "confidence")
    return forth.unionByName(back)


def keyword_edges(terms: DataFrame, sentences: DataFrame, relations: list[tuple[tuple[str, ...], str]], section: str = "section_id") -> DataFrame:
    """One edge for each section and relation: the first ordered pair of terms with a sentence that holds
    both and a marker of the relation. sentences: section, s, sentence; terms: section, pos, name."""
    marked = None
    for markers, relation in relations:
        one = sentences.where(T.contains_any(F.col("sentence"), markers)).withColumn("relation", F.lit(relation))
        marked = one if marked is None else marked.unionByName(one)
    held = terms.join(marked, section).where(F.contains("sentence", F.col("name"))).select(section, "relation", "s", "sentence", "pos", "name")
    other = held.select(section, "relation", "s", F.col("pos").alias("pos2"), F.col("name").alias("name2"))
    pairs = held.join(other, [section, "relation", "s"]).where("pos <> pos2 and name <> name2")
    r = F.row_number().over(Window.partitionBy(section, "relation").orderBy("pos", "pos2", "s"))
    return pairs.withColumn("r", r).where("r = 1").select(section, F.col("name").alias("source"), F.col("name2").alias("target"), "relation", T.trim_quote(F.col("sentence"), 160).alias("quote"))


def degrees(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """id, degree: how many edge ends a node has."""
    ends = edges.select(F.col(source).alias("id")).unionAll(edges.select(F.col(target).alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def edge_scores(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """edges (relation, confidence, contextual, verified, n_evidence) with a display score."""
    out = edges.join(weights, "relation", "left")
    base = F.col("confidence") * F.coalesce("weight", F.lit(1.0)) * F.when(F.col("contextual"), 0.48).otherwise(1.0)
    return out.withColumn("score", base + F.when(F.col("verified"), 0.35).otherwise(0.0) + F.least(F.col("n_evidence"), F.lit(3)) * 0.08)


def bfs(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, id, depth of all nodes at most `depth` undirected steps from each start; nodes once, at
    their least depth. edges: source, target; starts: start."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    seen = starts.select("start", F.col("start").alias("id"), F.lit(0).alias("depth"))
    front = seen
    for d in range(1, depth + 1):
        step = front.join(both, front["id"] == both["source"]).select("start", F.col("target").alias("id")).distinct()
        front = step.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """start, goal, hops, path: one shortest undirected path of at most `depth` steps for each pair, the
    first by relation priority, then the highest confidence, then node. edges: source, target, prio, confidence."""
    both = edges.select("source", "target", "prio", "confidence").unionByName(
        edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "prio", "confidence")
    )
    both = first_wins(both, ["source", "target"], ["prio", F.desc("confidence")])
    # a node with a single neighbour is inside no path, so it is met only as a goal
    through = both.groupBy("source").agg(F.count("*").alias("n")).where("n > 1").select(F.col("source").alias("target"))
    tables = Tables(edges.sparkSession)
    both, through = tables.write("both", both), tables.write("through", through)
    inner, ends = both.join(through, "target", "left_semi"), both.join(through, "target", "left_anti")
    front = pairs.select("start", "goal", F.array("start").alias("path"), F.array().cast("array<int>").alias("prios"))
    seen = pairs.select("start", "goal", F.col("start").alias("at"))
    found = None
    for hops in range(1, depth + 1):
        last = front.withColumn("at", F.element_at("path", -1))
        columns = [*last.columns, "source", "target", "prio"]
        step = last.join(inner, F.col("at") == F.col("source")).select(columns)
        step = step.unionByName(last.join(ends, (F.col("at") == F.col("source")) & (F.col("goal") == F.col("target"))).select(columns))
        step = step.select("start", "goal", F.concat("path", F.array("target")).alias("path"), F.concat("prios", F.array("prio")).alias("prios"), F.col("target").alias("at"))
        step = step.join(seen, ["start", "goal", "at"], "left_anti")
        order = Window.partitionBy("start", "goal", "at").orderBy("prios", "path")
        step = step.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
        step = tables.write(f"step{hops}", step)
        done = step.where("at = goal").select("start", "goal", F.lit(hops).alias("hops"), "path")
        found = done if found is None else found.unionByName(done)
        front = step.join(done.select("start", "goal"), ["start", "goal"], "left_anti").drop("at")
        seen = seen.unionByName(step.select("start", "goal", "at"))
    return found


def layer_nodes(books: DataFrame, sections: DataFrame, chunks: DataFrame, concepts: DataFrame, quotes: DataFrame) -> DataFrame:
    """One table of nodes with their layer; each input has id and label."""
    parts = [(books, "document_tree", "RawFile"), (sections, "document_tree", "Section"), (chunks, "document_tree", "Chunk"), (concepts, "concept_kg", "Concept"), (quotes, "evidence_graph", "SourceQuote")]
    out = None
    for df, layer, kind in parts:
        one = df.select("id", "label", F.lit(layer).alias("layer"), F.lit(kind).alias("node_type"))
        out = one if out is None else out.unionByName(one)
    return out


# The layers in order and whether they are built.
LAYERS = (
    ("document_tree", "ready"), ("concept_kg", "ready"), ("alias_alignment", "reserved"), ("evidence_graph", "ready"),
    ("integration_decision", "reserved"), ("teacher_edit", "reserved"), ("graphrag_retrieval", "reserved"),
)


def layer_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """layer, status, n_nodes, n_edges of all seven layers, the empty ones too."""
    dim = nodes.sparkSession.createDataFrame([(i, n, s) for i, (n, s) in enumerate(LAYERS)], "layer_order int, layer string, status string")
    n = nodes.groupBy("layer").agg(F.count("*").alias("n_nodes"))
    e = edges.groupBy("layer").agg(F.count("*").alias("n_edges"))
    return dim.join(n, "layer", "left").join(e, "layer", "left").select("layer_order", "layer", "status", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def display_nodes(nodes: DataFrame, scored_edges: DataFrame, n: int) -> DataFrame:
    """The n nodes with the highest own score plus the scores of their edges. nodes: id, base;
    scored_edges: source, target, score."""
    ends = scored_edges.select(F.col("source").alias("id"), "score").unionAll(scored_edges.select(F.col("target").alias("id"), "score"))
    gain = ends.groupBy("id").agg(F.sum("score").alias("gain"))
    out = nodes.join(gain, "id", "left").select("id", F.round(F.col("base") + F.coalesce("gain", F.lit(0.0)), 4).alias("score"))
    return out.orderBy(F.desc("score"), "id").limit(n)


def display_edges(scored_edges: DataFrame, kept: DataFrame, n: int) -> DataFrame:
    """The best edges between kept nodes, at most max(60, 2.35 n)."""
    ids = kept.select("id")
    inside = scored_edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return inside.orderBy(F.desc("score"), "source", "target").limit(max(60, int(2.35 * n)))


def node_details(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id, other, direction, relation, confidence of every edge at the given nodes."""
    out = edges.join(ids.select(F.col("id").alias("source")), "source").select(F.col("source").alias("id"), F.col("target").alias("other"), F.lit("out").alias("direction"), "relation", "confidence")
    back = edges.join(ids.select(F.col("id").alias("target")), "target").select(F.col("target").alias("id"), F.col("source").alias("other"), F.lit("in").alias("direction"), "relation", "confidence")
    return out.unionByName(back)


def evidence_edges(grounded: DataFrame, section: str = "section_id") -> DataFrame:
    """Edges of the evidence layer: a concept is evidenced by a chunk and has a quote that derives from it."""
    quote = T.stable_id("quote", F.col("chunk_id"), T.quote_hash(F.col("quote")))
    concept = T.stable_id("node", F.col(section), T.normalize_name(F.col("name")))
    rows = grounded.select(concept.alias("concept"), "chunk_id", quote.alias("quote_id"))
    kinds = [("EVIDENCED_BY", "concept", "chunk_id"), ("HAS_SOURCE_QUOTE", "concept", "quote_id"), ("DERIVED_FROM", "quote_id", "chunk_id")]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("relation"), F.col(a).alias("source"), F.col(b).alias("target")) for k, a, b in kinds]))
    return rows.select(each.alias("e")).select("e.source", "e.target", "e.relation").distinct()
