"""Queries on alignment, integration, questions and edits.

Part names by brand stand in for the concepts of several books; documents for their sections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import LATIN
from ..operators import align as L
from ..operators import ask as A
from ..operators import index as I
from ..operators import integrate as N
from ..operators import uploads as U
from .tables import table
from .text_plans import _rag, _ranked, _tf, _tokens, _vector


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """One node for each brand and part name."""
    part = table(spark, sf, "part").groupBy("p_brand", "p_name").agg(
        F.min("p_partkey").alias("node_id"), F.array_sort(F.collect_set("p_type")).alias("types"), F.array_sort(F.collect_set(F.col("p_size").cast("string"))).alias("neighbours"),
        F.count("*").alias("frequency"),
    )
    return part.select(
        "node_id", F.col("p_brand").alias("book"), F.col("p_name").alias("name"), F.array_join("types", " ").alias("definition"), F.get("types", F.lit(0)).alias("context"),
        F.array(F.substring_index("p_name", " ", -1)).alias("extra_aliases"), "neighbours", "frequency",
    )


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    feats = L.features(_nodes(spark, sf))
    tf = I.term_counts(feats.withColumn("all", F.concat_ws(" ", "name", "definition", "context")), "node_id", "all")
    return L.signals(L.candidate_pairs(feats), feats, I.hash_embedding(tf, "node_id", digits=None))


def align_signals(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda c: F.round(c, 4).alias(c)
    return _signals(spark, sf).select("l", "r", "s_name", "s_alias", r("s_definition"), r("s_context"), r("s_neighbour"), r("s_embedding"))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return L.candidates(_signals(spark, sf), ("SMALL",), ("LARGE",))


def align_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf).select("l", "r", "confidence", "relation", "needs_review")


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return L.clusters(_candidates(spark, sf), _nodes(spark, sf))


def align_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _members(spark, sf)


def cluster_confidence(spark: SparkSession, sf: str) -> DataFrame:
    out = L.cluster_confidence(_members(spark, sf), _candidates(spark, sf))
    return out.select("cluster", F.round("confidence", 3).alias("confidence"))


def _by_noun(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of nodes by the last word of their name."""
    nodes = _nodes(spark, sf)
    return nodes.select(F.get("extra_aliases", F.lit(0)).alias("cluster"), "node_id")


def canonical_name(spark: SparkSession, sf: str) -> DataFrame:
    return L.canonical_names(_by_noun(spark, sf), _nodes(spark, sf))


def alias_rows(spark: SparkSession, sf: str) -> DataFrame:
    members = _by_noun(spark, sf)
    return L.alias_rows(members, _nodes(spark, sf), L.canonical_names(members, _nodes(spark, sf)))


def _weighed(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with degree (order lines), evidence (suppliers) and importance."""
    lines = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("degree"), F.count_distinct("l_suppkey").alias("n_evidence"))
    part = table(spark, sf, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left").na.fill(0, ["degree", "n_evidence"])
    score = N.importance(F.lit(1), F.col("degree"), F.col("n_evidence"), F.col("p_type") == "ECONOMY", F.col("p_name").contains("ring"))
    return part.select("p_partkey", "p_name", "p_brand", "degree", "n_evidence", score.alias("importance"), F.length("p_name").alias("length"))


def importance(spark: SparkSession, sf: str) -> DataFrame:
    return _weighed(spark, sf).select("p_partkey", "degree", "n_evidence", "importance")


def representative(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.desc("length"), F.desc("degree"), F.desc("n_evidence"), F.col("p_name"), F.col("p_partkey")]
    return N.representative(_weighed(spark, sf), "p_brand", order).select("p_brand", "p_partkey", "p_name")


def _drafts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(
        "source", "doc_id", F.length("text").alias("length"), F.least(F.length("text"), F.lit(N.MIN_NEED)).cast("long").alias("need"),
        F.round(F.length("text") / 1000, 4).alias("importance"), (F.length("text") < 4500).alias("evictable"),
    )


def _limits(spark: SparkSession, sf: str, ratio: float) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(N.budget(F.sum(F.length("text")), ratio).alias("limit"))


def evict_budget(spark: SparkSession, sf: str) -> DataFrame:
    out = N.evict(_drafts(spark, sf), _limits(spark, sf, 0.01), "source", ["importance", "length", "doc_id"])
    return out.select("source", "doc_id", "need", "evicted")


def allocate_budget(spark: SparkSession, sf: str) -> DataFrame:
    return N.allocate(_drafts(spark, sf), _limits(spark, sf, N.RATIO), "source", "doc_id")


def shrink_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Openings of documents as definitions, for which sources have 60 characters each, or 9, which is below the least of the first pass."""
    docs = table(spark, sf, "documents")
    drafts = docs.select("source", "doc_id", F.round(-F.length("text") / 1000, 4).alias("order"), T.truncate(F.col("text"), 120).alias("definition"))
    limits = docs.groupBy("source").agg((F.count("*") * F.when(F.ascii(F.substring("source", -1, 1)) % 2 == 0, 60).otherwise(9)).alias("limit"))
    out = N.shrink(drafts, limits, "source", ["order", "doc_id"], "definition")
    return out.select("source", "doc_id", F.length("definition").alias("chars"), F.md5("definition").alias("md5"))


def compression_stats(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    action = F.when(n < 300, "remove").when(n < 900, "merge").when(n < 2500, "keep").when(n < 6000, "refine").otherwise("conflict")
    rows = table(spark, sf, "documents").select("source", action.alias("action"), n.alias("original"), F.least(n, F.lit(700)).alias("retained"))
    return N.compression_stats(rows, "source")


def integration_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """An action for every part name: conflicts, then merges and refinements, evicted or kept ones."""
    nodes = _nodes(spark, sf)
    members = nodes.groupBy(F.col("name").alias("unit")).agg(F.count_distinct("book").alias("n_books"), F.max(F.length("definition")).alias("longest"), F.min(F.length("definition")).alias("shortest"))
    ends = _candidates(spark, sf).where("relation = 'CONFLICTS_WITH'").select(F.explode(F.array("l", "r")).alias("node_id")).distinct()
    conflicts = ends.join(nodes.select("node_id", F.col("name").alias("unit")), "node_id").select("unit")
    evicted = nodes.groupBy(F.col("name").alias("unit")).agg(F.sum("frequency").alias("f")).where("f < 25").select("unit")
    return N.decide(members, conflicts, evicted)


def intent_class(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", A.intent(F.lower(F.coalesce("text", F.lit(""))), LATIN).alias("intent"))


def action_from_text(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", A.action_of(F.coalesce("text", F.lit("")), LATIN).alias("action"))


def node_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier-like questions (part type and name) asked of the nodes."""
    questions = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("question")).distinct().withColumn("question_id", F.col("question"))
    return A.node_hits(questions, _nodes(spark, sf), 5)


def evidence_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as evidence of four sources for their orders."""
    lines = table(spark, sf, "lineitem")
    source = F.element_at(F.array(*[F.lit(x) for x in A.SOURCE_FACTOR]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    evidence = lines.select(F.col("l_orderkey").alias("question_id"), (F.col("l_partkey") % 50).alias("chunk_id"), source.alias("source"), F.col("l_linenumber").cast("long") * 100_000 + F.col("l_partkey"), (F.col("l_quantity") / 50).alias("relevance"))
    evidence = evidence.toDF("question_id", "chunk_id", "source", "seq", "relevance")
    return A.rerank(evidence, 3)


def decision_override(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's standing, overridden by the latest error event; content only where the value is high."""
    events = table(spark, sf, "events")
    base = events.groupBy("user_id").agg(F.lit("keep").alias("action"), F.round(F.avg("value"), 4).alias("confidence"), F.min("event_type").alias("content"))
    edits = events.where("event_type = 'error'").select("user_id", F.struct("ts", "event_id").alias("seq"), F.lit("remove").alias("action"), F.col("value").alias("confidence"), F.when(F.col("value") > 20, F.col("props")).alias("content"))
    return N.apply_overrides(base, edits, "user_id")


def props_json(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


def upload_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as the parts of an upload: one part for each line number up to the order's last."""
    lines = table(spark, sf, "lineitem")
    parts = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("idx"), F.col("l_quantity").cast("long").alias("size"))
    sessions = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n_parts"))
    return N.upload_progress(parts, sessions, "l_orderkey").withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))


def _uploads(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each order is a file sent as its lines, 12 bytes a part but for the last; some parts are empty, too long or sent twice, and
    some files announce a digest or a size that is not theirs."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, sf, "lineitem").withColumn("part_no", F.row_number().over(order) - 1).withColumn("total", F.count("*").over(Window.partitionBy("l_orderkey")))
    body = F.concat(F.lpad(F.col("l_partkey").cast("string"), 9, "0"), "l_returnflag", "l_linestatus", F.lit("|"))
    sent = F.when(F.col("l_quantity") == 1, F.lit("")).when(F.col("l_quantity") == 2, F.concat(body, F.lit("+"))).when((F.col("l_quantity") == 3) & (F.col("part_no") == F.col("total") - 1), F.lit("end")).otherwise(body)
    parts = lines.select(F.col("l_orderkey").alias("session_id"), "part_no", F.lit(1).alias("seq"), sent.alias("content"))
    again = lines.where("l_quantity = 4").select("l_orderkey", "part_no", F.lit(2), F.lit("again-again-"))
    keys = lines.groupBy(F.col("l_orderkey").alias("session_id")).agg(F.count("*").alias("total_parts"), F.sum(F.length(sent)).alias("bytes"))
    sessions = keys.select("session_id", "total_parts", F.lit(12).alias("part_bytes"), (F.col("bytes") + F.when(F.col("session_id") % 11 == 0, 1).otherwise(0)).alias("total_bytes"), F.when(F.col("session_id") % 7 == 0, F.sha2(F.lit("other"), 256)).alias("sha256"))
    return sessions, parts.union(again).withColumn("content", F.col("content").cast("binary"))


def upload_assembly(spark: SparkSession, sf: str) -> DataFrame:
    return U.assemble(*_uploads(spark, sf))


def upload_errors(spark: SparkSession, sf: str) -> DataFrame:
    judged = U.judged_parts(*_uploads(spark, sf))
    return judged.groupBy(F.coalesce("error", F.lit("taken")).alias("error")).agg(F.count("*").alias("n"))


def graph_answers(spark: SparkSession, sf: str) -> DataFrame:
    """What the best passage of the benchmark says to each document title, or the refusal."""
    titles = table(spark, sf, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_type").alias("question"))
    docs = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("chunk_id"), F.col("text").alias("chunk"))
    best = I.top_k(I.score(titles, docs, LATIN), 1).join(docs, "chunk_id")
    cites = best.select("question_id", "rank", T.trim_quote(F.col("chunk"), 60).alias("quote"), F.col("chunk_id").alias("mark"))
    return A.answers(titles, cites)


QUERIES = {
    f.__name__: f
    for f in (
        align_signals, align_candidates, align_clusters, cluster_confidence, canonical_name, alias_rows, importance, representative, evict_budget, allocate_budget,
        shrink_budget, compression_stats, integration_decisions, intent_class, action_from_text, node_hits, evidence_rerank, decision_override, props_json, upload_missing, upload_assembly, upload_errors, graph_answers,
    )
}

_NODES = """nodes AS (
  SELECT min(p_partkey) AS node_id, p_brand AS book, p_name AS name, string_agg(DISTINCT p_type, ' ' ORDER BY p_type) AS definition, min(p_type) AS context,
    list_last(string_split(p_name, ' ')) AS noun, list_distinct(list(CAST(p_size AS VARCHAR))) AS neighbours, count(*) AS frequency
  FROM part GROUP BY p_brand, p_name)"""
_NORM = "regexp_replace(lower({}), '[\\s_\\-]+', '', 'g')"
_JACCARD = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"
_SIGNALS = f"""{_NODES}, feats AS (
  SELECT *, {_NORM.format('name')} AS norm, list_distinct([{_NORM.format('name')}, {_NORM.format('noun')}]) AS keys,
    list_distinct({_tokens('definition')}) AS dt, list_distinct({_tokens('context')}) AS ct, concat_ws(' ', name, definition, context) AS txt FROM nodes),
{_tf('ntf', 'feats', 'node_id', 'txt')}, {_vector('nvec', 'ntf', 'node_id', None)},
pairs AS (SELECT DISTINCT a.node_id AS l, b.node_id AS r FROM (SELECT *, unnest(keys) AS k FROM feats) a JOIN (SELECT *, unnest(keys) AS k FROM feats) b ON a.k = b.k AND a.node_id < b.node_id AND a.book <> b.book),
dots AS (SELECT l, r, sum(a.w * b.w) AS dot FROM pairs JOIN nvec a ON a.node_id = l JOIN nvec b ON b.node_id = r AND b.bucket = a.bucket GROUP BY l, r),
sig AS (
  SELECT l, r, CAST(CASE WHEN a.norm <> '' AND a.norm = b.norm THEN 1 ELSE 0 END AS DOUBLE) AS s_name, CAST(CASE WHEN len(list_intersect(a.keys, b.keys)) > 0 THEN 1 ELSE 0 END AS DOUBLE) AS s_alias,
    {_JACCARD.format('a.dt', 'b.dt')} AS s_definition, {_JACCARD.format('a.ct', 'b.ct')} AS s_context, {_JACCARD.format('a.neighbours', 'b.neighbours')} AS s_neighbour,
    greatest(0.0, coalesce(dot, 0.0)) AS s_embedding, length(a.definition) AS ll, length(b.definition) AS rl,
    concat_ws(' ', a.name, a.definition) AS lt, concat_ws(' ', b.name, b.definition) AS rt
  FROM pairs JOIN feats a ON a.node_id = l JOIN feats b ON b.node_id = r LEFT JOIN dots USING (l, r))"""
_CANDS = f"""{_SIGNALS}, conf AS (
  SELECT *, least(1.0, greatest(0.0, 0.24 * s_name + 0.26 * s_alias + 0.20 * s_definition + 0.10 * s_context + 0.10 * s_neighbour + 0.10 * s_embedding,
    CASE WHEN s_name >= 1 THEN 0.9 + 0.05 * s_definition ELSE 0.0 END, CASE WHEN s_alias >= 1 THEN 0.78 + 0.10 * s_definition + 0.05 * s_context + 0.05 * s_embedding ELSE 0.0 END)) AS c FROM sig),
rel AS (
  SELECT *, CASE WHEN s_alias >= 1 AND ((contains(lt, 'SMALL') AND contains(rt, 'LARGE')) OR (contains(rt, 'SMALL') AND contains(lt, 'LARGE'))) THEN 'CONFLICTS_WITH'
    WHEN s_alias >= 1 AND s_name < 1 THEN 'ALIAS_OF' WHEN least(ll, rl) > 0 AND greatest(ll, rl) / greatest(1, least(ll, rl)) >= 1.55 AND c >= 0.58 THEN 'REFINES' ELSE 'SAME_AS' END AS relation FROM conf),
cands AS (SELECT l, r, s_name, round(c, 4) AS confidence, relation, relation = 'CONFLICTS_WITH' OR c < 0.78 AS needs_review FROM rel WHERE c >= 0.62 OR relation = 'CONFLICTS_WITH')"""
_CANON = """names AS (SELECT noun AS cluster, name FROM nodes GROUP BY noun, name QUALIFY row_number() OVER (PARTITION BY noun ORDER BY count(*) DESC, name) = 1)"""
_WEIGHED = """weighed AS (
  SELECT p_partkey, p_name, p_brand, coalesce(degree, 0) AS degree, coalesce(n_evidence, 0) AS n_evidence,
    round(CAST(1.4 AS DOUBLE) * 1 + CAST(1.8 AS DOUBLE) * coalesce(degree, 0) + CAST(0.6 AS DOUBLE) * coalesce(n_evidence, 0)
      + (CASE WHEN p_type = 'ECONOMY' THEN CAST(1.5 AS DOUBLE) ELSE 0.0 END + CASE WHEN contains(p_name, 'ring') THEN CAST(1.2 AS DOUBLE) ELSE 0.0 END), 4) AS importance
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS degree, count(DISTINCT l_suppkey) AS n_evidence FROM lineitem GROUP BY ALL) ON l_partkey = p_partkey)"""


def _case(text: str, table_: list, other: str) -> str:
    rows = " ".join(f"WHEN {' OR '.join(f'contains({text}, {chr(39)}{m}{chr(39)})' for m in ms)} THEN '{v}'" for ms, v in table_)
    return f"CASE {rows} ELSE {other} END"


_DRAFTS = "drafts AS (SELECT source, doc_id, length(text) AS length, least(length(text), 48) AS need, round(length(text) / 1000, 4) AS importance, length(text) < 4500 AS evictable FROM documents)"

_UPLOADS = """numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS part_no, count(*) OVER (PARTITION BY l_orderkey) AS total,
  lpad(CAST(l_partkey AS VARCHAR), 9, '0') || l_returnflag || l_linestatus || '|' AS body FROM lineitem),
sent AS (SELECT l_orderkey AS session_id, part_no, total, l_quantity, CASE WHEN l_quantity = 1 THEN '' WHEN l_quantity = 2 THEN body || '+' WHEN l_quantity = 3 AND part_no = total - 1 THEN 'end' ELSE body END AS content FROM numbered),
sessions AS (SELECT session_id, count(*) AS total_parts, sum(length(content)) + CASE WHEN session_id % 11 = 0 THEN 1 ELSE 0 END AS total_bytes FROM sent GROUP BY session_id),
writes AS (SELECT session_id, part_no, total, 1 AS seq, content FROM sent UNION ALL SELECT session_id, part_no, total, 2, 'again-again-' FROM sent WHERE l_quantity = 4),
judged AS (SELECT *, CASE WHEN content = '' THEN 'empty' WHEN length(content) > 12 THEN 'too_large' WHEN part_no < total - 1 AND length(content) <> 12 THEN 'size' ELSE 'taken' END AS error FROM writes),
taken AS (SELECT session_id, part_no, last(content ORDER BY seq) AS content FROM judged WHERE error = 'taken' GROUP BY ALL)"""
_CUT = "CASE WHEN length({0}) <= {1} THEN {0} ELSE regexp_replace(substr({0}, 1, {1} - 1), '[ ，,；;。]+$', '') || '…' END"

ORACLE_SQL = {
    "upload_errors": f"WITH {_UPLOADS} SELECT error, count(*) AS n FROM judged GROUP BY error",
    "upload_assembly": f"""WITH {_UPLOADS}, got AS (SELECT session_id, count(*) AS n_parts, sum(length(content)) AS received, sha256(string_agg(content, '' ORDER BY part_no)) AS digest FROM taken GROUP BY session_id),
state AS (SELECT s.*, coalesce(n_parts, 0) AS n_parts, CAST(coalesce(received, 0) AS BIGINT) AS received, digest, total_parts - coalesce(n_parts, 0) AS n_missing FROM sessions s LEFT JOIN got USING (session_id)),
named AS (SELECT *, CASE WHEN n_missing > 0 THEN 'missing' WHEN received <> total_bytes THEN 'size_mismatch' WHEN session_id % 7 = 0 THEN 'sha256_mismatch' ELSE 'assembled' END AS status FROM state)
SELECT session_id, n_parts, n_missing, received, CAST(CASE WHEN total_bytes > 0 THEN least(100, floor(received / total_bytes * 100)) ELSE 0 END AS INTEGER) AS progress, status,
  CASE WHEN status = 'assembled' THEN digest END AS digest, CASE WHEN status = 'assembled' THEN 'upload_' || substr(digest, 1, 16) END AS file_id FROM named""",
    "shrink_budget": f"""WITH lim AS (SELECT source, count(*) * CASE WHEN ascii(right(source, 1)) % 2 = 0 THEN 60 ELSE 9 END AS lim FROM documents GROUP BY source),
d AS (SELECT source, doc_id, -round(length(text) / 1000, 4) AS o, {_CUT.format('text', 120)} AS t FROM documents),
a AS (SELECT *, greatest(0, length(t) - 12) AS free, greatest(0, sum(length(t)) OVER (PARTITION BY source) - lim) AS over_all FROM d JOIN lim USING (source)),
b AS (SELECT *, CAST(greatest(0, least(free, over_all - coalesce(sum(free) OVER (PARTITION BY source ORDER BY o DESC, doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS gives,
  CAST(greatest(0, over_all - sum(free) OVER (PARTITION BY source)) AS BIGINT) AS over_rest FROM a),
c AS (SELECT source, doc_id, o, over_rest, CASE WHEN gives = 0 THEN t ELSE {_CUT.format('t', '(length(t) - gives)')} END AS t FROM b),
e AS (SELECT *, CAST(greatest(0, least(greatest(0, length(t) - 1), over_rest - coalesce(sum(greatest(0, length(t) - 1)) OVER (PARTITION BY source ORDER BY o DESC, doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS gives FROM c),
f AS (SELECT source, doc_id, CASE WHEN gives = 0 THEN t ELSE {_CUT.format('t', '(length(t) - gives)')} END AS t FROM e)
SELECT source, doc_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS md5 FROM f""",
    "align_signals": f"WITH {_SIGNALS} SELECT l, r, s_name, s_alias, round(s_definition, 4) AS s_definition, round(s_context, 4) AS s_context, round(s_neighbour, 4) AS s_neighbour, round(s_embedding, 4) AS s_embedding FROM sig",
    "align_candidates": f"WITH {_CANDS} SELECT l, r, confidence, relation, needs_review FROM cands",
    # align_clusters, cluster_confidence: recursion over whole classes is too slow; tests hold them against brute force
    "canonical_name": f"WITH {_NODES}, {_CANON} SELECT * FROM names",
    "alias_rows": f"WITH {_NODES}, {_CANON} SELECT noun AS cluster, n.name AS canonical, nodes.name AS alias, count(*) AS n_members FROM nodes JOIN names n ON n.cluster = noun WHERE nodes.name <> n.name GROUP BY ALL",
    "importance": f"WITH {_WEIGHED} SELECT p_partkey, degree, n_evidence, importance FROM weighed",
    "representative": f"WITH {_WEIGHED} SELECT p_brand, p_partkey, p_name FROM weighed QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, degree DESC, n_evidence DESC, p_name, p_partkey) = 1",
    "evict_budget": f"""WITH {_DRAFTS}, lim AS (SELECT source, greatest(1, floor(sum(length(text)) * CAST(0.01 AS DOUBLE))) AS lim, sum(least(length(text), 48)) AS total FROM documents GROUP BY ALL),
r AS (SELECT d.*, lim, total, coalesce(sum(CASE WHEN evictable THEN need ELSE 0 END) OVER (PARTITION BY source ORDER BY CASE WHEN evictable THEN 0 ELSE 1 END, importance, length, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM drafts d JOIN lim USING (source))
SELECT source, doc_id, CAST(need AS BIGINT) AS need, evictable AND total - freed > lim AS evicted FROM r""",
    "allocate_budget": f"""WITH RECURSIVE {_DRAFTS}, r AS (SELECT source, doc_id, length, greatest(1.0, importance) AS w, row_number() OVER (PARTITION BY source ORDER BY importance DESC, doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM drafts),
lim AS (SELECT source, CAST(greatest(1, floor(sum(length(text)) * CAST(0.30 AS DOUBLE))) AS BIGINT) AS lim FROM documents GROUP BY ALL),
tot AS (SELECT source, sum(w ORDER BY i) AS tw FROM r GROUP BY ALL),
f AS (
  SELECT source, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS chars, lim AS rest, tw AS wleft FROM lim JOIN tot USING (source)
  UNION ALL
  SELECT s.source, s.i, s.doc_id, s.used, s.rest - s.used, s.wleft - s.w FROM (
    SELECT r.source, r.i, r.doc_id, f.rest, f.wleft, r.w,
      CAST(least(greatest(1, CASE WHEN r.n = r.i THEN f.rest ELSE least(greatest(12, CAST(floor(f.rest * r.w / f.wleft) AS BIGINT)), f.rest - 12 * (r.n - r.i)) END), r.length) AS BIGINT) AS used
    FROM f JOIN r ON r.source = f.source AND r.i = f.i + 1) s)
SELECT source, doc_id, chars FROM f WHERE i > 0""",
    "compression_stats": """WITH d AS (SELECT source, length(text) AS n, CASE WHEN length(text) < 300 THEN 'remove' WHEN length(text) < 900 THEN 'merge' WHEN length(text) < 2500 THEN 'keep' WHEN length(text) < 6000 THEN 'refine' ELSE 'conflict' END AS action FROM documents),
s AS (SELECT source, count(*) FILTER (action = 'merge') AS n_merge, count(*) FILTER (action = 'refine') AS n_refine, count(*) FILTER (action = 'keep') AS n_keep, count(*) FILTER (action = 'remove') AS n_remove, count(*) FILTER (action = 'conflict') AS n_conflict,
  CAST(sum(n) AS BIGINT) AS original_chars, CAST(sum(CASE WHEN action = 'remove' THEN 0 ELSE least(n, 700) END) AS BIGINT) AS retained_chars FROM d GROUP BY source)
SELECT *, round(retained_chars / greatest(original_chars, 1), 4) AS ratio FROM s""",
    "integration_decisions": f"""WITH {_CANDS}, m AS (SELECT name AS unit, count(DISTINCT book) AS n_books, max(length(definition)) AS longest, min(length(definition)) AS shortest, sum(frequency) AS f FROM nodes GROUP BY name),
x AS (SELECT DISTINCT name AS unit FROM cands JOIN nodes ON node_id = l OR node_id = r WHERE relation = 'CONFLICTS_WITH')
SELECT unit, CASE WHEN unit IN (SELECT unit FROM x) THEN 'conflict' WHEN n_books > 1 AND longest >= CAST(1.55 AS DOUBLE) * greatest(shortest, 1) THEN 'refine' WHEN n_books > 1 THEN 'merge' WHEN f < 25 THEN 'remove' ELSE 'keep' END AS action FROM m""",
    "intent_class": f"SELECT conv_id, turn, {_case('t', LATIN.intents, chr(39) + 'hybrid' + chr(39))} AS intent FROM (SELECT *, lower(coalesce(text, '')) AS t FROM conversations)",
    "action_from_text": f"SELECT conv_id, turn, {_case('t', LATIN.actions, 'NULL')} AS action FROM (SELECT *, lower(coalesce(text, '')) AS t FROM conversations)",
    "node_hits": f"""WITH {_NODES}, q AS (SELECT DISTINCT concat_ws(' ', p_name, p_type) AS question FROM part),
qt AS (SELECT DISTINCT question, unnest({_tokens('question')}) AS term FROM q), nt AS (SELECT DISTINCT node_id, unnest({_tokens("concat_ws(' ', name, definition)")}) AS term FROM nodes),
h AS (SELECT question, node_id, count(*) AS overlap FROM qt JOIN nt USING (term) GROUP BY ALL),
s AS (SELECT question, node_id, name, overlap * CAST(0.45 AS DOUBLE) + CASE WHEN contains(lower(question), lower(name)) THEN 3.5 ELSE 0.0 END + CASE WHEN contains(question, name) THEN 2.0 ELSE 0.0 END AS raw FROM h JOIN nodes USING (node_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY raw DESC, name, node_id) AS INTEGER) AS rank FROM s WHERE raw >= CAST(1.2 AS DOUBLE) QUALIFY rank <= 15)
SELECT question AS question_id, node_id, round(least(1.0, raw / max(raw) OVER (PARTITION BY question)), 4) AS score, rank FROM r""",
    "evidence_rerank": """WITH e AS (SELECT l_orderkey AS question_id, l_partkey % 50 AS chunk_id, l_suppkey % 4 AS sr, CAST(l_linenumber AS BIGINT) * 100000 + l_partkey AS seq, l_quantity / 50 AS q FROM lineitem),
f AS (SELECT *, round(q * CASE sr WHEN 0 THEN CAST(1.0 AS DOUBLE) WHEN 1 THEN CAST(0.92 AS DOUBLE) WHEN 2 THEN CAST(0.88 AS DOUBLE) ELSE CAST(0.86 AS DOUBLE) END, 4) AS relevance FROM e
  QUALIFY row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY sr, seq, q DESC) = 1)
SELECT question_id, chunk_id, CASE sr WHEN 0 THEN 'rag' WHEN 1 THEN 'node' WHEN 2 THEN 'path' ELSE 'decision' END AS source, relevance,
  CAST(row_number() OVER (PARTITION BY question_id ORDER BY relevance DESC, sr, seq, chunk_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 3""",
    "decision_override": """WITH b AS (SELECT user_id, round(avg(value), 4) AS confidence, min(event_type) AS content FROM events GROUP BY user_id),
e AS (SELECT user_id, value, props FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT b.user_id, CASE WHEN e.user_id IS NULL THEN 'keep' ELSE 'remove' END AS action, coalesce(e.value, b.confidence) AS confidence,
  coalesce(CASE WHEN e.value > 20 THEN e.props END, b.content) AS content, e.user_id IS NOT NULL AS edited FROM b LEFT JOIN e USING (user_id)""",
    "props_json": "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS max_k FROM events GROUP BY event_type",
    "graph_answers": f"""WITH questions AS (SELECT p_partkey AS question_id, p_type AS question FROM part), passages AS (SELECT CAST(item_id AS VARCHAR) AS chunk_id, text AS chunk FROM benchmark),
{_rag('questions', 'passages')}, {_ranked('score', 1)}
SELECT question_id, coalesce(substring(trim(regexp_replace(chunk, '\\s+', ' ', 'g')), 1, 60) || ' [' || chunk_id || ']', '{A.NO_ANSWER}') AS answer FROM questions LEFT JOIN (SELECT * FROM ranked JOIN passages USING (chunk_id)) USING (question_id)""",
    "upload_missing": """WITH s AS (SELECT l_orderkey, max(l_linenumber) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS received, list_distinct(list(l_linenumber - 1)) AS have FROM lineitem GROUP BY ALL)
SELECT l_orderkey, received, CAST(n AS INTEGER) AS n_parts, array_to_string(list_filter(range(0, n), lambda x: NOT list_contains(have, CAST(x AS INTEGER))), ',') AS missing, CAST(floor(100 * len(have) / n) AS INTEGER) AS percent FROM s""",
}
