"""The result of an integration: conflicts, drafts of concepts, the budget, decisions, concepts and totals.

nodes: group (a report), node_id (string), name, text (definition, quote or name), importance, frequency (long),
confidence, n_chunks, n_locators (evidence). members: cluster (string), node_id, pos (the order in a cluster).
clusters: cluster, name, confidence. candidates: candidate (id), l, r, relation, confidence, reason, rank (their order).

A cluster may hold any share of all nodes, so nothing is listed a cluster: members, redundant texts and
decisions of a concept are tables of their own, one row each, and what a draft says of them is bounded (two
supplements, two reasons, the number of redundant nodes). Ids of clusters' decisions and concepts are made from the cluster, those of
single nodes from name and node. Ids of nodes are unique, and a node is in one cluster at most; nodes without an id are left out, as are nodes that members or candidates name but that do not exist, and
clusters with fewer than two nodes. Null names and texts are empty. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import integrate as N
from .scratch import Tables


@dataclass(frozen=True)
class Wording:
    """What decisions and concepts say, as formats with %s."""

    conflict_content: str
    conflict_reason: str  # the candidate's reason
    refine_reason: str  # name, representative, number of redundant nodes, reasons of candidates
    merge_reason: str
    refine_without: str
    merge_without: str
    keep_reason: str  # name, importance, frequency
    guarded_reason: str  # name
    remove_reason: str  # name
    supplement: str  # definition, supplements
    redundant_merge: str
    redundant_refine: str
    merge_summary: str  # name
    refine_summary: str
    keep_summary: str
    join: str = "；"


# The wording of Chinese reports.
ZH = Wording(
    conflict_content="保留冲突两侧原始说法，等待教师裁定；不直接合并或删除。",
    conflict_reason="%s 阶段 8 将其标为 conflict，压缩时强制保留两侧证据。",
    refine_reason="%s 的跨教材说法存在粒度差异，保留 %s 的完整定义并吸收 %s 个节点的补充信息；依据：%s。",
    merge_reason="%s 在多本教材中被判定为同一/别名概念，保留 %s 的较完整定义，将 %s 个节点的重复解释并入冗余记录；依据：%s。",
    refine_without="定义长度和上下文差异",
    merge_without="对齐置信度和证据重合",
    keep_reason="%s 未命中可合并重复项，重要度 %.2f，频次 %d，作为独立知识点保留。",
    guarded_reason="%s 参与冲突候选，阶段 8 必须保留原始说法，等待教师裁定。",
    remove_reason="%s 为低频/低连接度 singleton，阶段 8 为满足压缩预算将其从整合正文移除；原始节点和证据不删除，可在溯源中恢复。",
    supplement="%s 补充：%s",
    redundant_merge="重复解释已压缩",
    redundant_refine="保留为补充差异",
    merge_summary="%s 已跨教材合并，保留代表定义并记录冗余来源。",
    refine_summary="%s 保留主定义和补充差异，等待教师可选精修。",
    keep_summary="%s 作为独立知识点保留。",
)
#: Characters of a redundant text that are kept, and bounds of a removal's confidence (fixed values).
REDUNDANT_CHARS, LEAST_CONFIDENCE, MOST_CONFIDENCE, OTHER_CONFIDENCE = 80, 0.55, 0.86, 0.72


def _known(nodes: DataFrame) -> DataFrame:
    """Nodes with an id; null names and texts as empty ones."""
    empty = {c: F.coalesce(c, F.lit("")) for c in ("name", "text")}
    return nodes.where("node_id is not null").withColumns(empty)


def conflicts(candidates: DataFrame, nodes: DataFrame, words: Wording = ZH) -> DataFrame:
    """A decision for each conflicting candidate whose nodes both exist: both texts stay until a teacher decides."""
    side = lambda k: _known(nodes).select(F.col("node_id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("group", "name", "n_chunks", "n_locators")])
    met = candidates.where("relation = 'CONFLICTS_WITH'").join(side("l"), "l").join(side("r"), "r")
    return met.select(
        F.col("l_group").alias("group"), T.stable_id("integration_decision", F.lit("conflict"), F.col("candidate")).alias("decision_id"), "l", "r",
        F.col("l_name").alias("source_name"), F.col("r_name").alias("target_name"), F.lit(words.conflict_content).alias("content"),
        F.format_string(words.conflict_reason, F.coalesce("reason", F.lit(""))).alias("reason"), "confidence",
        (F.col("l_n_chunks") + F.col("r_n_chunks")).alias("n_chunks"), (F.col("l_n_locators") + F.col("r_n_locators")).alias("n_locators"),
    )


def guarded_nodes(conflict_rows: DataFrame) -> DataFrame:
    """node_id of every end of a conflict."""
    return conflict_rows.select(F.explode(F.array("l", "r")).alias("node_id")).distinct()


def _first_two(rows: DataFrame, key: str, pos: list[str], value: str, joined: str) -> DataFrame:
    """key and the values at its two lowest positions as one text: two partial aggregates, no group in one task."""
    at = F.struct(*pos, value)
    one = rows.groupBy(key).agg(F.min(at).alias("_a"))
    two = rows.join(one.select(F.col(key), "_a"), key).where(at > F.col("_a")).groupBy(key).agg(F.min(at).alias("_b"))
    return one.join(two, key, "left").select(key, F.concat_ws(joined, F.col("_a")[value], F.col("_b")[value]).alias(value))


def _tokens(text: Column) -> Column:
    """Distinct Latin words and pairs of ideographs."""
    return F.array_distinct(F.concat(T.latin_words(text), T.cjk_grams(text, (2,), 0)))


def placed_members(nodes: DataFrame, members: DataFrame, candidates: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The known members of clusters of two or more, each with its node, the cluster's action and representative.

    cluster, node_id, pos, name, text, ..., action, rep (the representative's node_id, name and text), n_members. The representative has the
    longest text, then the highest degree (weights: node_id, degree), then most evidence, then the first name and id.
    """
    degrees = nodes.select("node_id", F.lit(0).alias("degree")) if weights is None else weights
    rows = members.select("cluster", "node_id", "pos").dropDuplicates(["cluster", "node_id"]).join(_known(nodes), "node_id").join(degrees, "node_id", "left")
    side = lambda c: members.select(F.col("node_id").alias(c), F.col("cluster").alias("cluster")).distinct()
    refined = candidates.where("relation = 'REFINES'").join(side("l"), "l").join(side("r"), ["r", "cluster"]).select("cluster").distinct()
    order = F.struct((-F.length("text")).alias("o1"), (-F.coalesce("degree", F.lit(0))).alias("o2"), (-F.col("n_chunks")).alias("o3"), "name", "node_id", "text")
    per = rows.groupBy("cluster").agg(F.count("*").alias("n_members"), F.min(order).alias("_r")).where("n_members > 1")
    per = per.join(refined.withColumn("_f", F.lit(True)), "cluster", "left")
    per = per.select("cluster", "n_members", F.when(F.col("_f"), "refine").otherwise("merge").alias("action"), F.struct("_r.node_id", "_r.name", "_r.text").alias("rep"))
    return rows.join(per, "cluster").drop("degree")


def cluster_drafts(placed: DataFrame, clusters: DataFrame, candidates: DataFrame, guarded: DataFrame, words: Wording = ZH) -> DataFrame:
    """One draft a cluster: the representative's text and up to two supplements, in order of members, of texts that
    share few words with it (or any text, where the cluster refines), and why."""
    others = placed.where("node_id <> rep.node_id")
    base = _tokens(F.col("rep.text"))
    few = F.size(F.array_intersect(base, _tokens(F.col("text")))) < F.greatest(F.lit(2), F.floor(F.size(base) / 5))
    adds = others.where((F.col("text") != "") & ((F.col("action") == "refine") | few))
    adds = _first_two(adds.select("cluster", "pos", "node_id", F.col("text").alias("adds")), "cluster", ["pos", "node_id"], "adds", " ")
    side = lambda c: placed.select(F.col("node_id").alias(c), "cluster")
    inside = candidates.where("reason is not null").join(side("l"), "l").join(side("r"), ["r", "cluster"])
    said = _first_two(inside.select("cluster", "rank", "candidate", F.col("reason").alias("said")), "cluster", ["rank", "candidate"], "said", words.join)
    mark = guarded.withColumn("_g", F.lit(True))
    per = placed.join(mark, "node_id", "left").groupBy("group", "cluster", "action", "rep", "n_members").agg(
        F.round(F.sum("importance"), 4).alias("importance"), F.sum("n_chunks").alias("n_chunks"), F.sum("n_locators").alias("n_locators"), F.coalesce(F.bool_or("_g"), F.lit(False)).alias("guarded"),
    )
    out = per.join(clusters.withColumn("name", F.coalesce("name", F.lit(""))), "cluster").join(adds, "cluster", "left").join(said, "cluster", "left")
    refines = F.col("action") == "refine"
    why = F.when(F.length("said") > 0, F.col("said")).when(refines, words.refine_without).otherwise(words.merge_without)
    parts = (F.col("name"), F.col("rep.name"), (F.col("n_members") - 1).cast("string"), why)
    return out.select(
        "group", F.col("cluster").alias("draft"), F.lit(True).alias("clustered"), "action", "name", "n_members", F.col("rep.node_id").alias("representative"),
        F.when(F.col("adds").isNull(), F.col("rep.text")).otherwise(F.format_string(words.supplement, "rep.text", "adds")).alias("text"),
        "importance", "confidence", "guarded", F.col("guarded").alias("force_retain"),
        F.when(refines, F.format_string(words.refine_reason, *parts)).otherwise(F.format_string(words.merge_reason, *parts)).alias("reason"), "n_chunks", "n_locators",
    )


def single_drafts(nodes: DataFrame, placed: DataFrame, guarded: DataFrame, words: Wording = ZH) -> DataFrame:
    """A draft to keep for each node that no cluster covers; ends of conflicts and important nodes stay whatever the budget."""
    alone = _known(nodes).join(placed.select("node_id").distinct(), "node_id", "left_anti").join(guarded.withColumn("_g", F.lit(True)), "node_id", "left")
    held = F.coalesce("_g", F.lit(False))
    keeps = F.format_string(words.keep_reason, F.col("name"), F.col("importance").cast("double"), F.col("frequency").cast("long"))
    return alone.select(
        "group", F.col("node_id").alias("draft"), F.lit(False).alias("clustered"), F.lit("keep").alias("action"), "name", F.lit(1).cast("long").alias("n_members"), F.col("node_id").alias("representative"),
        "text", "importance", "confidence", held.alias("guarded"), (held | (F.col("importance") >= N.FORCE_RETAIN)).alias("force_retain"),
        F.when(held, F.format_string(words.guarded_reason, "name")).otherwise(keeps).alias("reason"), F.col("n_chunks").cast("long").alias("n_chunks"), F.col("n_locators").cast("long").alias("n_locators"),
    )


def redundancies(placed: DataFrame, words: Wording = ZH) -> DataFrame:
    """draft, node_id, pos, kind, detail of every redundant member: its name and the opening of its text."""
    kind = F.when(F.col("action") == "refine", words.redundant_refine).otherwise(words.redundant_merge)
    detail = F.concat("name", F.lit(": "), T.truncate(F.col("text"), REDUNDANT_CHARS))
    return placed.where("node_id <> rep.node_id").select(F.col("cluster").alias("draft"), "node_id", "pos", kind.alias("kind"), detail.alias("detail"))


def within_budget(drafts: DataFrame, originals: DataFrame, ratio: float = N.RATIO, words: Wording = ZH) -> DataFrame:
    """drafts with definition: the cheapest single drafts of a group are removed until the least need fits the
    budget, and the others' texts are cut to their shares of it. originals: group, original (characters).

    A removed draft has no definition, and its confidence and reason are those of a removal.
    """
    limits = originals.select("group", N.budget(F.col("original"), ratio).alias("limit"))
    rows = drafts.withColumns({
        "length": F.length("text").cast("long"), "need": F.least(F.length("text"), F.lit(N.MIN_NEED)).cast("long"), "evictable": (F.col("action") == "keep") & ~F.col("force_retain"),
    })
    tables = Tables(drafts.sparkSession)
    rows = tables.write("rows", rows)  # two passes read it
    judged = tables.write("judged", N.evict(rows, limits, "group", ["importance", "length", "name", "draft"]))
    # equal importance goes by name, then by draft
    kept = judged.where("not evicted").withColumn("_key", F.struct("name", "clustered", "draft"))
    shares = N.allocate(kept, limits, "group", "_key")
    cut = kept.join(shares, ["group", "_key"]).withColumn("definition", T.truncate(F.col("text"), F.col("chars").cast("int")))
    cut = N.shrink(cut.withColumn("_o", -F.col("importance")), limits, "group", ["_o", "name", "clustered", "draft"], "definition")
    gone = judged.where("evicted").withColumns({
        "action": F.lit("remove"), "definition": F.lit(None).cast("string"), "reason": F.format_string(words.remove_reason, "name"),
        "confidence": F.greatest(F.lit(LEAST_CONFIDENCE), F.least(F.lit(MOST_CONFIDENCE), F.when(F.col("confidence") != 0, F.col("confidence")).otherwise(OTHER_CONFIDENCE))),
    })
    columns = [*drafts.columns, "definition"]
    return cut.select(*columns).unionByName(gone.select(*columns))


def _parts() -> tuple[Column, ...]:
    """What the id of a draft is made from, after its action."""
    return (F.when(F.col("clustered"), F.col("draft")).otherwise(F.concat_ws("|", "name", "draft")),)


def decisions(budgeted: DataFrame, conflict_rows: DataFrame, keeps: bool = True) -> DataFrame:
    """group, decision_id, draft (null: a conflict), cluster, action, content, reason, confidence, n_targets, n_chunks, n_locators, complete.

    complete: whether reason, confidence, chunks and locators are there. Decisions to keep can be left out.
    """
    rows = budgeted if keeps else budgeted.where("action <> 'keep'")
    own = rows.select(
        "group", T.stable_id("integration_decision", F.col("action"), *_parts()).alias("decision_id"), "draft", F.when(F.col("clustered"), F.col("draft")).alias("cluster"), "action",
        F.col("definition").alias("content"), "reason", F.round("confidence", 4).alias("confidence"), F.col("n_members").alias("n_targets"), "n_chunks", "n_locators",
    )
    other = conflict_rows.select(
        "group", "decision_id", F.lit(None).cast("string").alias("draft"), F.lit(None).cast("string").alias("cluster"), F.lit("conflict").alias("action"), "content", "reason", "confidence",
        F.lit(2).cast("long").alias("n_targets"), "n_chunks", "n_locators",
    )
    done = (F.length("reason") > 0) & (F.col("confidence") > 0) & (F.col("n_chunks") > 0) & (F.col("n_locators") > 0)
    return own.unionByName(other).withColumn("complete", F.coalesce(done, F.lit(False)))


def concepts(budgeted: DataFrame, words: Wording = ZH) -> DataFrame:
    """group, concept_id, draft, name, action, definition, summary, confidence, n_members, guarded of every draft that is not removed."""
    says = F.when(F.col("action") == "merge", F.format_string(words.merge_summary, "name")).when(F.col("action") == "refine", F.format_string(words.refine_summary, "name"))
    return budgeted.where("action <> 'remove'").select(
        "group", T.stable_id("integrated_concept", *_parts()).alias("concept_id"), "draft", "name", "action", "definition",
        says.otherwise(F.format_string(words.keep_summary, "name")).alias("summary"), F.round("confidence", 4).alias("confidence"), "n_members", "guarded",
    )


def draft_members(budgeted: DataFrame, placed: DataFrame) -> DataFrame:
    """draft, node_id: what each draft stands for."""
    single = budgeted.where("not clustered").select("draft", F.col("draft").alias("node_id"))
    return placed.select(F.col("cluster").alias("draft"), "node_id").unionByName(single)


def concept_decisions(concept_rows: DataFrame, decision_rows: DataFrame, conflict_rows: DataFrame, of: DataFrame) -> DataFrame:
    """concept_id, decision_id: the decisions that share a node with a concept. of: as `draft_members` gives it.

    Nodes are in one draft each, so these are its own decision and the conflicts of its nodes; no two lists meet.
    """
    own = concept_rows.select("draft", "concept_id").join(decision_rows.select("draft", "decision_id"), "draft").select("concept_id", "decision_id")
    ends = conflict_rows.select("decision_id", F.explode(F.array("l", "r")).alias("node_id"))
    met = ends.join(of, "node_id").join(concept_rows.select("draft", "concept_id"), "draft")
    return own.unionByName(met.select("concept_id", "decision_id")).distinct()


def totals(concept_rows: DataFrame, decision_rows: DataFrame, nodes: DataFrame, originals: DataFrame, ratio: float = N.RATIO) -> DataFrame:
    """Sizes, counts and ratios of each group before and after integration."""
    kept = concept_rows.groupBy("group").agg(F.count("*").alias("n_concepts"), F.coalesce(F.sum(F.length("definition")), F.lit(0)).alias("retained"))
    all_ = nodes.groupBy("group").agg(F.count("*").alias("n_nodes"))
    targets = lambda a, n: F.coalesce(F.sum(F.when(F.col("action") == a, n)), F.lit(0)).cast("long")
    n = F.col("n_targets")
    made = decision_rows.groupBy("group").agg(
        F.count("*").alias("n_decisions"), targets("merge", n - 1).alias("merged"), targets("keep", n).alias("kept"), targets("remove", n).alias("removed"),
        targets("refine", F.greatest(F.lit(1), n - 1)).alias("refined"), F.count_if(F.col("action") == "conflict").alias("conflicts"), F.count_if("complete").alias("complete"),
    )
    rows = originals.select("group", F.col("original").cast("long").alias("original")).join(all_, "group", "left").join(kept, "group", "left").join(made, "group", "left")
    rows = rows.na.fill(0)
    share = lambda a, b: F.when(F.col(b) > 0, F.round(a / F.col(b), 4)).otherwise(0.0)
    rows = rows.withColumns({
        "ratio": share(F.col("retained"), "original"), "node_reduction": share(F.greatest(F.lit(0), F.col("n_nodes") - F.col("n_concepts")), "n_nodes"),
        "evidence_coverage": share(F.col("complete"), "n_decisions"),
    })
    return rows.withColumn("target_met", (F.col("original") == 0) | (F.col("ratio") <= ratio)).drop("complete")
