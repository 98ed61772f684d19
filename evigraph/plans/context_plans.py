"""Queries on context edges, drafts of decisions, views of a graph, and text cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import LATIN
from ..operators import context as X
from ..operators import graph as G
from .graph_plans import _CHUNKS, _GROUND, _QUOTE, _STAR, _TERMS, _WHOLE, _chunks, _star, _terms, bfs_depth
from .graph_plans import ORACLE_SQL as _GRAPH_SQL
from .merge_plans import _CANDS, _WEIGHED, _by_noun, _candidates, _weighed
from .tables import table


def same_chunk_edges(spark: SparkSession, sf: str) -> DataFrame:
    return X.same_chunk_edges(G.ground(_terms(spark, sf), _chunks(spark, sf), "doc_id"), "doc_id")


def section_hub_edges(spark: SparkSession, sf: str) -> DataFrame:
    return X.section_hub_edges(_terms(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").withColumnRenamed("source", "file"), "file", "doc_id")


def prerequisite_edges(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.regexp_replace("text", r"\.", "；")
    said = table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(marked)).alias("s", "sentence"))
    return X.prerequisite_edges(_terms(spark, sf), said, LATIN.prerequisite, "doc_id")


def _part_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that follow each other in an order."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return G.adjacent_edges(items, "l_orderkey", ["l_linenumber", "l_partkey"], "l_partkey", "PARALLEL_WITH", G.CONFIDENCE["adjacent"], G.ADJACENT_CAP)


def keyword_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type")
    return X.keyword_subgraph(nodes, _part_edges(spark, sf).select("l_orderkey", "source", "target"), " RING ")


def chain_edges(spark: SparkSession, sf: str) -> DataFrame:
    return X.chain_edges(_star(spark, sf), bfs_depth(spark, sf))


def relation_groups(spark: SparkSession, sf: str) -> DataFrame:
    return X.relation_groups(_star(spark, sf))


def section_chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many chunks each document has; none where it has no text."""
    counts = _chunks(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"))
    return table(spark, sf, "documents").select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_chunks"))


def chunk_order(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each chunk among all chunks of its file (source)."""
    chunks = _chunks(spark, sf).select("doc_id", "chunk_no").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    # places are the chunks of earlier documents and the place in the document, so no window holds chunks of a whole file
    per = chunks.groupBy("source", "doc_id").agg(F.count("*").alias("n"))
    own = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_no")) - 1
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chunks.withColumn("own", own).join(per.select("doc_id", before.alias("before")), "doc_id").select("source", "doc_id", "chunk_no", (F.col("before") + F.col("own")).alias("order_index"))


def section_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, nations and suppliers as sections, sub-sections and theirs."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    top = table(spark, sf, "region").select(node("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").alias("seq"))
    mid = table(spark, sf, "nation").select(node("n", "n_nationkey"), node("r", "n_regionkey"), "n_nationkey")
    low = table(spark, sf, "supplier").select(node("s", "s_suppkey"), node("n", "s_nationkey"), "s_suppkey")
    return X.section_tree(top.union(mid).union(low)).withColumn("path", F.array_join("path", "/"))


def _named(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by name as clusters; the type stands in for the definition."""
    return _weighed(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_type", "p_size"), "p_partkey").select(
        F.concat_ws("|", "p_name", "p_brand", "p_type").alias("cluster"), F.col("p_partkey").alias("node_id"), "importance", F.length("p_type").alias("length"), "p_size"
    )


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    named = _named(spark, sf)
    many = named.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    return named.join(many, "cluster", "left_semi")


def _guarded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("node_id"))


def singleton_drafts(spark: SparkSession, sf: str) -> DataFrame:
    return X.singleton_drafts(_named(spark, sf).select("node_id", "importance"), _clusters(spark, sf), _guarded(spark, sf))


def cluster_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Members of a cluster refine each other where their sizes are far apart."""
    own = _clusters(spark, sf)
    ends = own.groupBy("cluster").agg(F.min_by("node_id", F.struct("p_size", "node_id")).alias("l"), F.max_by("node_id", F.struct("p_size", "node_id")).alias("r"), (F.max("p_size") - F.min("p_size")).alias("d"))
    pairs = ends.select("l", "r", F.when(F.col("d") >= 20, "REFINES").otherwise("SAME_AS").alias("relation"))
    return X.cluster_drafts(own, pairs, _guarded(spark, sf))


def sorted_decisions(spark: SparkSession, sf: str) -> DataFrame:
    action = F.element_at(F.array(*[F.lit(a) for a in X.ACTIONS]), (F.col("p_size") % 5 + 1).cast("int"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), action.alias("action"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("cluster"))
    return X.sort_decisions(rows)


def alias_relations(spark: SparkSession, sf: str) -> DataFrame:
    return X.alias_relations(_by_noun(spark, sf), _candidates(spark, sf))


def readiness(spark: SparkSession, sf: str) -> DataFrame:
    return X.readiness(table(spark, sf, "documents").select("source", "doc_id"), table(spark, sf, "labels").select("doc_id"), "source", "doc_id")


def cleaned_text(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = X.clean_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(cleaned).alias("md5"), F.length(cleaned).cast("long").alias("n_chars"))


def text_aliases(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat_ws("", "p_type", F.lit(" ("), "p_name", F.lit(")"))
    return table(spark, sf, "part").select("p_partkey", F.posexplode(X.aliases_from_text(said)).alias("pos", "alias"))


QUERIES = {
    f.__name__: f
    for f in (
        same_chunk_edges, section_hub_edges, prerequisite_edges, keyword_subgraph, chain_edges, relation_groups, section_chunk_counts, chunk_order, section_tree,
        singleton_drafts, cluster_drafts, sorted_decisions, alias_relations, readiness, cleaned_text, text_aliases,
    )
}

_MARKED = " OR ".join(f"contains(sentence, '{m}')" for m in LATIN.prerequisite)
_CLUSTERED = f"""{_WEIGHED}, named AS (SELECT w.p_name || '|' || w.p_brand || '|' || p.p_type AS cluster, p_partkey AS node_id, importance, length(p.p_type) AS length, p.p_size FROM weighed w JOIN part p USING (p_partkey)),
clustered AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM named)"""
_OUT = " ".join(f"WHEN '{r}' THEN '{g}'" for r, g in X.GROUPS.items())
_FORTH = " ".join(f"WHEN '{r}' THEN '{g[0]}'" for r, g in X.DIRECTED_GROUPS.items())
_BACK = " ".join(f"WHEN '{r}' THEN '{g[1]}'" for r, g in X.DIRECTED_GROUPS.items())
_ACTION = "CASE p_size % 5 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(X.ACTIONS)) + " END"

ORACLE_SQL = {
    "same_chunk_edges": f"""WITH {_TERMS}, {_CHUNKS}, {_GROUND}, g AS (
  SELECT *, min(pos) OVER (PARTITION BY doc_id, chunk_id) AS c0, lead(name) OVER (PARTITION BY doc_id, chunk_id ORDER BY pos) AS nxt FROM grounded)
SELECT doc_id, chunk_id, name AS source, nxt AS target, 'MENTIONED_IN' AS relation, CAST(0.5 AS DOUBLE) AS confidence FROM g WHERE nxt IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c0, pos) <= 8""",
    "section_hub_edges": f"""WITH {_TERMS}, h AS (SELECT d.source AS file, t.doc_id, t.name FROM terms t JOIN documents d USING (doc_id) WHERE t.pos = 0),
l AS (SELECT file, doc_id, name AS target, lag(name) OVER (PARTITION BY file ORDER BY doc_id) AS source FROM h)
SELECT file, doc_id, source, target, 'PARALLEL_WITH' AS relation, CAST(0.38 AS DOUBLE) AS confidence FROM l WHERE source IS NOT NULL AND source <> target""",
    "prerequisite_edges": f"""WITH {_TERMS}, {_WHOLE}, held AS (SELECT w.doc_id, w.s, w.sentence, t.pos, t.name FROM whole w JOIN terms t ON t.doc_id = w.doc_id AND contains(w.sentence, t.name)),
pairs AS (SELECT a.doc_id, a.pos, b.pos AS pos2, a.name, b.name AS name2, a.sentence FROM held a JOIN held b ON a.doc_id = b.doc_id AND a.s = b.s AND a.pos <> b.pos AND a.name <> b.name
  QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.pos, b.pos ORDER BY a.s) = 1)
SELECT doc_id, name AS source, name2 AS target, 'PREREQUISITE_OF' AS relation, {_QUOTE.format('sentence')} AS quote FROM pairs WHERE {_MARKED}
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos, pos2) = 1""",
    "keyword_subgraph": """WITH kept AS (SELECT p_partkey AS id FROM part WHERE contains(lower(p_name || ' ' || p_type), 'ring')),
e AS (SELECT l_orderkey, l_partkey AS source, row_number() OVER w AS rn, lead(l_partkey) OVER w AS target FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey))
SELECT l_orderkey, source, target FROM e WHERE rn <= 10 AND target <> source AND source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)""",
    "chain_edges": f"""WITH depths AS ({_GRAPH_SQL['bfs_depth']}), {_STAR}
SELECT DISTINCT a.start, source, target, greatest(a.depth, b.depth) AS depth FROM star JOIN depths a ON a.id = source JOIN depths b ON b.id = target AND b.start = a.start WHERE abs(a.depth - b.depth) <= 1""",
    "relation_groups": f"""WITH {_STAR} SELECT node, grp, count(*) AS n FROM (
  SELECT source AS node, CASE relation {_FORTH} {_OUT} ELSE 'other' END AS grp FROM star UNION ALL SELECT target, CASE relation {_BACK} {_OUT} ELSE 'other' END FROM star) GROUP BY ALL""",
    "section_chunk_counts": f"WITH {_CHUNKS} SELECT d.doc_id, count(c.chunk_no) AS n_chunks FROM documents d LEFT JOIN chunks c USING (doc_id) GROUP BY d.doc_id",
    "chunk_order": f"WITH {_CHUNKS} SELECT source, doc_id, chunk_no, row_number() OVER (PARTITION BY source ORDER BY doc_id, chunk_no) - 1 AS order_index FROM chunks JOIN documents d USING (doc_id)".replace("SELECT source,", "SELECT d.source,").replace("BY source ORDER", "BY d.source ORDER"),
    "section_tree": """WITH RECURSIVE s AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_regionkey AS seq FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey FROM supplier),
t AS (SELECT id, 0 AS depth, CAST(seq AS VARCHAR) AS path FROM s WHERE parent IS NULL OR parent NOT IN (SELECT id FROM s)
  UNION ALL SELECT s.id, depth + 1, path || '/' || seq FROM s JOIN t ON s.parent = t.id)
SELECT id, depth, path FROM t""",
    "singleton_drafts": f"""WITH {_CLUSTERED} SELECT node_id, 'keep' AS action, importance, p_size = 1 AS conflict_guarded, p_size = 1 OR importance >= 4.5 AS force_retain FROM clustered WHERE n = 1""",
    "cluster_drafts": f"""WITH {_CLUSTERED} SELECT cluster, CASE WHEN max(p_size) - min(p_size) >= 20 THEN 'refine' ELSE 'merge' END AS action,
  first(node_id ORDER BY length DESC, importance DESC, node_id) AS representative, count(*) AS n_members, round(sum(importance), 4) AS importance, bool_or(p_size = 1) AS force_retain
FROM clustered WHERE n > 1 GROUP BY cluster""",
    "sorted_decisions": f"SELECT p_partkey AS id, {_ACTION} AS action, CASE WHEN p_size % 2 = 0 THEN p_brand END AS cluster, CAST(p_size % 5 AS INTEGER) AS action_order FROM part",
    "alias_relations": f"""WITH {_CANDS}, c AS (SELECT a.noun AS cluster, relation FROM cands JOIN nodes a ON a.node_id = l JOIN nodes b ON b.node_id = r AND b.noun = a.noun)
SELECT noun AS cluster, CASE WHEN bool_or(relation = 'ALIAS_OF') THEN 'ALIAS_OF' WHEN bool_or(relation = 'REFINES') THEN 'REFINES' ELSE 'SAME_AS' END AS relation
FROM (SELECT DISTINCT noun FROM nodes) LEFT JOIN c ON c.cluster = noun GROUP BY noun""",
    "readiness": "SELECT source, count(*) AS n, count(*) FILTER (WHERE l.doc_id IS NULL) AS n_missing, count(*) FILTER (WHERE l.doc_id IS NULL) = 0 AS ready FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY source",
    "cleaned_text": """WITH c AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(replace(text, chr(65279), ''), '\\r\\n?', chr(10), 'g'), chr(10)),
  lambda x: trim(regexp_replace(x, '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS t FROM documents)
SELECT doc_id, md5(t) AS md5, length(t) AS n_chars FROM c""",
    "text_aliases": """WITH p AS (SELECT p_partkey, p_type || ' (' || p_name || ')' AS t FROM part),
f AS (SELECT p_partkey, list_concat(regexp_extract_all(t, '[(（]([A-Za-z][A-Za-z\\s\\-]{1,40})[)）]', 1), regexp_extract_all(t, '\\b[A-Za-z][A-Za-z\\s\\-]{2,40}\\b')) AS xs FROM p),
u AS (SELECT p_partkey, i, regexp_replace(lower(x), '[\\s_\\-]+', '', 'g') AS alias FROM (SELECT p_partkey, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM f)),
d AS (SELECT p_partkey, alias, min(i) AS i FROM u WHERE alias <> '' GROUP BY ALL)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS INTEGER) AS pos, alias FROM d""",
}
