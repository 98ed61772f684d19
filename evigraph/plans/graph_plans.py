"""Queries on the knowledge graph: terms, evidence, nodes, edges, layers and traversal.

The foreign keys of the star schema stand in for concept edges where a query is about graph shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import LATIN
from ..operators import ask as A
from ..operators import chunking as C
from ..operators import display as D
from ..operators import graph as G
from ..operators.components import connected_components
from .tables import table

TERM_LIMIT = 12
#: Nodes shown of a graph.
SHOWN = 60


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 40).alias("title"), "text")
    return G.section_terms(docs, LATIN, TERM_LIMIT, "doc_id", "text", "title")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("text", F.regexp_replace("text", r"\.", "；"))
    return C.chunks(docs).withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_no"))


def term_filter(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select(F.explode(F.array("p_name", "p_type", "p_brand")).alias("raw")).distinct()
    return names.select("raw", G.clean_term(F.col("raw")).alias("name"), G.good_term(G.clean_term(F.col("raw")), LATIN).alias("good"))


def section_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf)


def ground_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return G.ground(_terms(spark, sf), _chunks(spark, sf), "doc_id")


def keyword_edges(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.regexp_replace("text", r"\.", "；")
    said = table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(marked)).alias("s", "sentence"))
    return G.keyword_edges(_terms(spark, sf), said, LATIN.relations, "doc_id")


def node_merge(spark: SparkSession, sf: str) -> DataFrame:
    out = G.merge_nodes(table(spark, sf, "part"), "p_brand", "p_name", "p_partkey", "p_type")
    return out.select("p_brand", "name_key", "name", "frequency", F.array_join("evidence", "|").alias("evidence"), "confidence")


def edge_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    return G.first_wins(edges, ["l_partkey", "l_suppkey", "l_returnflag"], ["l_orderkey", "l_linenumber", "l_quantity"])


def context_hub(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("n"))
    return G.hub_edges(items.withColumn("o", F.struct("n", "l_partkey")), "l_orderkey", "o", "l_partkey")


def context_adjacent(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return G.adjacent_edges(items, "l_orderkey", ["l_linenumber", "l_partkey"], "l_partkey", "PARALLEL_WITH", G.CONFIDENCE["adjacent"], G.ADJACENT_CAP)


def next_previous(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", T.stable_id("turn", F.col("conv_id"), F.col("turn")).alias("node"))
    return G.sequence_edges(turns, "conv_id", ["turn", "node"], "node")


def _star(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of customers, suppliers, nations, regions; the relation has a priority and a confidence."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation = table(spark, sf, "nation").select(node("n", "n_nationkey").alias("source"), node("r", "n_regionkey").alias("target"), F.lit("PART_OF").alias("relation"), F.lit(0.9).alias("confidence"))
    supplier = table(spark, sf, "supplier").select(node("s", "s_suppkey").alias("source"), node("n", "s_nationkey").alias("target"), F.lit("CONTAINS").alias("relation"), F.round(0.5 + F.col("s_acctbal") / 40000, 4).alias("confidence"))
    customer = table(spark, sf, "customer").select(node("c", "c_custkey").alias("source"), node("n", "c_nationkey").alias("target"), F.lit("IS_A").alias("relation"), F.round(0.5 + F.col("c_acctbal") / 40000, 4).alias("confidence"))
    return nation.unionByName(supplier).unionByName(customer)


def node_degree(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(_star(spark, sf))


def orphan_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without an order, by market segment and in all."""
    customers = table(spark, sf, "customer")
    ordering = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(1))
    return customers.join(ordering, "c_custkey", "left").rollup("c_mktsegment").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("has").isNull()).alias("n_orphans"))


def neighbour_top3(spark: SparkSession, sf: str) -> DataFrame:
    return A.neighbour_paths(_star(spark, sf), 3).select("node", "other", "relation", "confidence", "rank")


def bfs_depth(spark: SparkSession, sf: str) -> DataFrame:
    starts = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("start"))
    return G.bfs(_star(spark, sf), starts, 2)


def shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of at most 4 steps from each supplier to a nation of the same region, if region keys repeat by five."""
    edges = _star(spark, sf)
    prio = F.lit(len(G.PATH_PRIORITY))
    for i, r in enumerate(G.PATH_PRIORITY):
        prio = F.when(F.col("relation") == r, i).otherwise(prio)
    pairs = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("start"), F.concat(F.lit("n"), ((F.col("s_nationkey") + 5) % 25).cast("string")).alias("goal"))
    return G.shortest_paths(edges.where("relation <> 'IS_A'").withColumn("prio", prio), pairs, 4).select("start", "goal", "hops", F.array_join("path", ">").alias("path"))


def components(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of parts and orders that order lines link."""
    lines = table(spark, sf, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("b"))
    return connected_components(lines)


def edge_scores(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n_evidence"), F.min("l_returnflag").alias("flag"), F.max("l_quantity").alias("q"))
    relation = F.when(F.col("flag") == "A", "CAUSES").when(F.col("flag") == "N", "CONTAINS").otherwise("MENTIONED_IN")
    edges = lines.withColumn("relation", relation).withColumn("confidence", F.col("q") / 50).withColumn("contextual", F.col("flag") == "R").withColumn("verified", F.col("q") > 25)
    weights = spark.createDataFrame([("CAUSES", 1.4), ("CONTAINS", 0.7), ("MENTIONED_IN", 0.4)], "relation string, weight double")
    return G.edge_scores(edges, weights).select("l_partkey", "l_suppkey", "relation", F.round("score", 6).alias("score"))


def _brand_graphs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """One graph for each brand: its parts, linked where a supplier's order lines of the brand follow each other."""
    part = table(spark, sf, "part")
    nodes = part.select(F.col("p_brand").alias("graph"), F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), (2.24 + F.least("p_size", F.lit(10)) * 0.7).alias("base"))
    lines = table(spark, sf, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("graph")), "l_partkey")
    follow = Window.partitionBy("graph", "l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    lines = lines.withColumn("target", F.lead("l_partkey").over(follow)).where("target is not null and target <> l_partkey")
    edges = lines.groupBy("graph", F.col("l_partkey").alias("source"), "target", "l_returnflag").agg(F.count("*").alias("n_evidence"), F.max("l_quantity").alias("q"))
    relation = F.when(F.col("l_returnflag") == "A", "CAUSES").when(F.col("l_returnflag") == "N", "CONTAINS").otherwise("MENTIONED_IN")
    edges = edges.withColumn("relation", relation).withColumn("confidence", F.col("q") / 50).withColumn("contextual", F.col("l_returnflag") == "R").withColumn("verified", F.col("q") > 25)
    weights = spark.createDataFrame([("CAUSES", 2.3), ("CONTAINS", 1.4), ("MENTIONED_IN", 0.45)], "relation string, weight double")
    seq = (F.col("source") * 10**9 + F.col("target")) * 3 + F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return nodes, G.edge_scores(edges, weights).select("graph", seq.cast("long").alias("seq"), "source", "target", F.round("score", 6).alias("score"), "contextual")


def shown_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The part of each brand's graph that is shown with 60 nodes; held against a walk in tests, as its choices are sequential."""
    return D.display(*_brand_graphs(spark, sf), SHOWN)[0]


def shown_edges(spark: SparkSession, sf: str) -> DataFrame:
    return D.display(*_brand_graphs(spark, sf), SHOWN)[1].drop("contextual")


def _star_scored(spark: SparkSession, sf: str) -> DataFrame:
    weights = spark.createDataFrame([("PART_OF", 0.9), ("CONTAINS", 0.7), ("IS_A", 0.8)], "relation string, weight double")
    edges = _star(spark, sf).withColumns({"contextual": F.col("relation") == "CONTAINS", "verified": F.col("confidence") > 0.6, "n_evidence": F.lit(1)})
    return G.edge_scores(edges, weights).select("source", "target", F.round("score", 6).alias("score"))


def _star_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(_star(spark, sf)).select("id", (F.col("degree") * 0.1).alias("base"))


def display_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return G.display_nodes(_star_nodes(spark, sf), _star_scored(spark, sf), 100)


def display_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.display_edges(_star_scored(spark, sf), G.display_nodes(_star_nodes(spark, sf), _star_scored(spark, sf), 100), 100)


def node_details(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    return G.node_details(_star(spark, sf), ids)


def evidence_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.evidence_edges(G.ground(_terms(spark, sf), _chunks(spark, sf), "doc_id"), "doc_id")


def layer_summary(spark: SparkSession, sf: str) -> DataFrame:
    docs, chunks, terms = table(spark, sf, "documents"), _chunks(spark, sf), _terms(spark, sf)
    grounded = G.ground(terms, chunks, "doc_id")
    label = lambda df, i, t: df.select(F.col(i).cast("string").alias("id"), F.col(t).alias("label"))
    nodes = G.layer_nodes(
        label(docs.select("lang").distinct(), "lang", "lang"), label(docs.withColumn("t", F.substring("text", 1, 40)), "doc_id", "t"), label(chunks, "chunk_id", "chunk_id"),
        label(terms.select("name").distinct(), "name", "name"), label(grounded.select("chunk_id", "quote").distinct(), "chunk_id", "quote"),
    )
    edges = G.sequence_edges(chunks.select("doc_id", "chunk_no", "chunk_id"), "doc_id", ["chunk_no"], "chunk_id").select(F.lit("document_tree").alias("layer"))
    said = grounded.select(F.lit("evidence_graph").alias("layer"))
    return G.layer_summary(nodes, edges.unionByName(said))


QUERIES = {
    f.__name__: f
    for f in (
        shown_nodes, shown_edges, term_filter, section_terms, ground_evidence, keyword_edges, node_merge, edge_first_wins, context_hub, context_adjacent, next_previous, node_degree,
        orphan_rollup, neighbour_top3, bfs_depth, shortest_path, components, edge_scores, display_nodes, display_edges, node_details, evidence_edges, layer_summary,
    )
}

_STAR = """star AS (
  SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'PART_OF' AS relation, CAST(0.9 AS DOUBLE) AS confidence FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'CONTAINS', round(0.5 + s_acctbal / 40000, 4) FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'IS_A', round(0.5 + c_acctbal / 40000, 4) FROM customer)"""
_BOTH = "ends AS (SELECT source AS node, target AS other, relation, confidence FROM star UNION ALL SELECT target, source, relation, confidence FROM star)"

_STRIP = """[ ：:，,。；;（）()\\[\\]【】"'']"""


def _clean(term: str) -> str:
    """The Latin part of term cleaning: the markers and prefixes of the other pack do not occur."""
    out = f"trim(regexp_replace({term}, '\\s+', ' ', 'g'))"
    out = f"regexp_replace({out}, '^[第0-9一二三四五六七八九十百章节篇、\\s.．]+', '')"
    return f"regexp_replace({out}, '^{_STRIP}+|{_STRIP}+$', '', 'g')"


def _good(name: str) -> str:
    starts = " OR ".join(f"starts_with({name}, '{p}')" for p in LATIN.bad_prefixes)
    ends = " OR ".join(f"ends_with({name}, '{p}')" for p in LATIN.bad_endings)
    frags = " OR ".join(f"contains({name}, '{p}')" for p in LATIN.bad_fragments)
    verbs = " OR ".join(f"contains({name}, '{v}')" for v in LATIN.bad_verbs)
    particles = f"length({name}) - length(replace({name}, '{LATIN.particle}', ''))"
    return (
        f"(NOT (length({name}) > 8 AND ({verbs})) AND NOT (length({name}) > 10 AND {particles} >= {2 * len(LATIN.particle)}) AND "
        f"length({name}) BETWEEN 2 AND 40 AND NOT regexp_matches({name}, '^[0-9]{{1,4}}$') AND NOT ({starts}) AND NOT ({ends}) AND NOT ({frags}) "
        f"AND NOT regexp_matches({name}, '[。！？；;，,]') AND (length({name}) <= 18 OR regexp_matches({name}, '[A-Za-z]')) AND regexp_matches({name}, '[一-鿿A-Za-z]'))"
    )


_P1, _P2 = LATIN.term_patterns
_TERMS = f"""raw AS (
  SELECT doc_id, list_concat([substring(text, 1, 40)], regexp_extract_all(text, '{_P1}', 1), regexp_extract_all(text, '{_P2}', 1)) AS xs FROM documents
), named AS (
  SELECT doc_id, x, i, {_clean('x')} AS name FROM (SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM raw)
), firsts AS (SELECT doc_id, name, min(i) AS i FROM named WHERE {_good('name')} GROUP BY ALL),
terms AS (
  SELECT doc_id, CAST(rn - 1 AS INTEGER) AS pos, name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM firsts) WHERE rn <= {TERM_LIMIT})"""
_CHUNKS = """chunks AS (SELECT *, doc_id || '-' || chunk_no AS chunk_id FROM (
  SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, regexp_replace(substring(replace(text, '.', '；'), CAST(chunk_no * 620 + 1 AS BIGINT), 700), '^\\s+|\\s+$', '', 'g') AS chunk
  FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil((length(text) - 80) / 620.0) AS BIGINT)))) AS chunk_no FROM documents WHERE length(text) > 0)
) WHERE length(chunk) > 0),
said AS (
  SELECT doc_id, chunk_id, chunk_no, sentence, row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS s FROM (
    SELECT doc_id, chunk_id, chunk_no, regexp_replace(unnest(xs), '^\\s+|\\s+$', '', 'g') AS sentence, generate_subscripts(xs, 1) AS i FROM (
      SELECT *, regexp_extract_all(chunk, '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$') AS xs FROM chunks)) WHERE sentence <> '')"""
_WHOLE = """whole AS (
  SELECT doc_id, regexp_replace(unnest(xs), '^\\s+|\\s+$', '', 'g') AS sentence, generate_subscripts(xs, 1) AS s FROM (
    SELECT doc_id, regexp_extract_all(replace(text, '.', '；'), '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$') AS xs FROM documents))"""
_QUOTE = "substring(trim(regexp_replace({}, '\\s+', ' ', 'g')), 1, 160)"
_GROUND = f"""grounded AS (
  SELECT t.doc_id, t.pos, t.name, coalesce(b.chunk_id, c.chunk_id) AS chunk_id, coalesce({_QUOTE.format('b.sentence')}, {_QUOTE.format('c.chunk')}) AS quote,
    CASE WHEN b.chunk_id IS NOT NULL THEN 'term_sentence' ELSE 'fallback_first_chunk' END AS strategy
  FROM terms t
  LEFT JOIN (SELECT t.doc_id, t.pos, s.chunk_id, s.sentence FROM terms t JOIN said s ON s.doc_id = t.doc_id AND contains(s.sentence, t.name)
    QUALIFY row_number() OVER (PARTITION BY t.doc_id, t.pos ORDER BY s.chunk_no, s.s) = 1) b USING (doc_id, pos)
  JOIN (SELECT doc_id, chunk_id, chunk FROM chunks QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) = 1) c USING (doc_id))"""
_MARKERS = " UNION ALL ".join(
    f"SELECT '{r}' AS relation, doc_id, s, sentence FROM whole WHERE ({' OR '.join(f'contains(sentence, {chr(39)}{m}{chr(39)})' for m in ms)})" for ms, r in LATIN.relations
)

_SHOWN = f"""{_STAR}, se AS (
  SELECT source, target, round(confidence * CASE relation WHEN 'PART_OF' THEN CAST(0.9 AS DOUBLE) WHEN 'CONTAINS' THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END
    * CASE WHEN relation = 'CONTAINS' THEN CAST(0.48 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END + CASE WHEN confidence > CAST(0.6 AS DOUBLE) THEN CAST(0.35 AS DOUBLE) ELSE 0.0 END + CAST(0.08 AS DOUBLE), 6) AS score FROM star),
ends2 AS (SELECT source AS id, score FROM se UNION ALL SELECT target, score FROM se),
shown AS (SELECT id, round(count(*) * CAST(0.1 AS DOUBLE) + sum(score), 4) AS score FROM ends2 GROUP BY id ORDER BY score DESC, id LIMIT 100)"""

ORACLE_SQL = {
    "display_nodes": f"WITH {_SHOWN} SELECT id, score FROM shown",
    "display_edges": f"WITH {_SHOWN} SELECT source, target, score FROM se WHERE source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown) ORDER BY score DESC, source, target LIMIT 235",
    "node_details": f"""WITH {_STAR} SELECT source AS id, target AS other, 'out' AS direction, relation, confidence FROM star WHERE starts_with(source, 'n')
UNION ALL SELECT target, source, 'in', relation, confidence FROM star WHERE starts_with(target, 'n')""",
    "evidence_edges": f"""WITH {_TERMS}, {_CHUNKS}, {_GROUND}, x AS (
  SELECT 'node_' || substring(sha256(doc_id || '|' || lower(regexp_replace(name, '\\s+', '', 'g'))), 1, 16) AS concept, chunk_id, 'quote_' || substring(sha256(chunk_id || '|' || substring(sha256(quote), 1, 16)), 1, 16) AS quote_id FROM grounded)
SELECT concept AS source, chunk_id AS target, 'EVIDENCED_BY' AS relation FROM x UNION SELECT concept, quote_id, 'HAS_SOURCE_QUOTE' FROM x UNION SELECT quote_id, chunk_id, 'DERIVED_FROM' FROM x""",
    "term_filter": f"SELECT raw, {_clean('raw')} AS name, {_good(_clean('raw'))} AS good FROM (SELECT DISTINCT unnest([p_name, p_type, p_brand]) AS raw FROM part)",
    "section_terms": f"WITH {_TERMS} SELECT doc_id, pos, name FROM terms",
    "ground_evidence": f"WITH {_TERMS}, {_CHUNKS}, {_GROUND} SELECT * FROM grounded",
    "keyword_edges": f"""WITH {_TERMS}, {_WHOLE}, marked AS ({_MARKERS}),
held AS (SELECT m.*, t.pos, t.name FROM marked m JOIN terms t ON t.doc_id = m.doc_id AND contains(m.sentence, t.name))
SELECT a.doc_id, a.name AS source, b.name AS target, a.relation, {_QUOTE.format('a.sentence')} AS quote
FROM held a JOIN held b ON a.doc_id = b.doc_id AND a.relation = b.relation AND a.s = b.s AND a.pos <> b.pos AND a.name <> b.name
QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.relation ORDER BY a.pos, b.pos, a.s) = 1""",
    "node_merge": """WITH d AS (SELECT *, lower(regexp_replace(p_name, '\\s+', '', 'g')) AS name_key FROM part),
e AS (SELECT p_brand, name_key, string_agg(p_type, '|' ORDER BY k) AS evidence FROM (SELECT p_brand, name_key, p_type, min(p_partkey) AS k FROM d GROUP BY ALL) GROUP BY ALL)
SELECT p_brand, name_key, arg_min(p_name, p_partkey) AS name, count(*) AS frequency, any_value(evidence) AS evidence, CAST(0.62 AS DOUBLE) AS confidence FROM d JOIN e USING (p_brand, name_key) GROUP BY p_brand, name_key""",
    "edge_first_wins": """SELECT l_partkey, l_suppkey, l_returnflag, l_orderkey, l_linenumber, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_quantity) = 1""",
    "context_hub": """WITH i AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rn, first_value(l_partkey) OVER w AS hub FROM i WINDOW w AS (PARTITION BY l_orderkey ORDER BY n, l_partkey))
SELECT l_orderkey, hub AS source, l_partkey AS target, 'CONTAINS' AS relation, CAST(0.48 AS DOUBLE) AS confidence FROM r WHERE rn BETWEEN 2 AND 9""",
    "context_adjacent": """SELECT l_orderkey, l_partkey AS source, nxt AS target, 'PARALLEL_WITH' AS relation, CAST(0.46 AS DOUBLE) AS confidence FROM (
  SELECT l_orderkey, l_partkey, row_number() OVER w AS rn, lead(l_partkey) OVER w AS nxt FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey))
WHERE nxt IS NOT NULL AND rn <= 10 AND nxt <> l_partkey""",
    "next_previous": """WITH t AS (SELECT conv_id, turn, 'turn_' || substring(sha256(conv_id || '|' || turn), 1, 16) AS node FROM conversations),
f AS (SELECT conv_id, node AS source, lead(node) OVER (PARTITION BY conv_id ORDER BY turn, node) AS target FROM t QUALIFY target IS NOT NULL AND target <> node)
SELECT conv_id, source, target, 'NEXT' AS relation, CAST(1.0 AS DOUBLE) AS confidence FROM f UNION ALL SELECT conv_id, target, source, 'PREVIOUS', CAST(1.0 AS DOUBLE) FROM f""",
    "node_degree": f"WITH {_STAR} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM star UNION ALL SELECT target FROM star) GROUP BY ALL",
    "orphan_rollup": "SELECT c_mktsegment, count(*) AS n_nodes, count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS n_orphans FROM customer GROUP BY ROLLUP (c_mktsegment)",
    "neighbour_top3": f"""WITH {_STAR}, {_BOTH} SELECT node, other, relation, confidence, CAST(row_number() OVER (PARTITION BY node ORDER BY confidence DESC, relation, other) AS INTEGER) AS rank FROM ends QUALIFY rank <= 3""",
    "bfs_depth": f"""WITH RECURSIVE {_STAR}, {_BOTH}, walk AS (
  SELECT 'r' || r_regionkey AS start, 'r' || r_regionkey AS id, 0 AS depth FROM region
  UNION SELECT start, other, depth + 1 FROM walk JOIN ends ON node = id WHERE depth < 2)
SELECT start, id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY start, id""",
    "shortest_path": f"""WITH RECURSIVE {_STAR}, e AS (
  SELECT node, other, min(prio) AS prio FROM (
    SELECT source AS node, target AS other, CASE relation WHEN 'PART_OF' THEN 5 ELSE 8 END AS prio FROM star WHERE relation <> 'IS_A'
    UNION ALL SELECT target, source, CASE relation WHEN 'PART_OF' THEN 5 ELSE 8 END FROM star WHERE relation <> 'IS_A') GROUP BY ALL),
walk AS (
  SELECT 's' || s_suppkey AS start, 'n' || ((s_nationkey + 5) % 25) AS goal, 's' || s_suppkey AS cur, 0 AS hops, 's' || s_suppkey AS path, '' AS prios FROM supplier
  UNION ALL SELECT start, goal, other, hops + 1, path || '>' || other, prios || prio FROM walk JOIN e ON node = cur
  WHERE hops < 4 AND cur <> goal AND NOT list_contains(string_split(path, '>'), other))
SELECT start, goal, CAST(hops AS INTEGER) AS hops, path FROM walk WHERE cur = goal QUALIFY row_number() OVER (PARTITION BY start, goal ORDER BY hops, prios, path) = 1""",
    # components: recursion over classes as large as the table is too slow; tests hold it against union-find
    "edge_scores": """WITH l AS (SELECT l_partkey, l_suppkey, count(*) AS n, min(l_returnflag) AS flag, max(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT l_partkey, l_suppkey, CASE flag WHEN 'A' THEN 'CAUSES' WHEN 'N' THEN 'CONTAINS' ELSE 'MENTIONED_IN' END AS relation,
  round(q / 50 * CASE flag WHEN 'A' THEN CAST(1.4 AS DOUBLE) WHEN 'N' THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END * CASE WHEN flag = 'R' THEN CAST(0.48 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END
    + CASE WHEN q > 25 THEN CAST(0.35 AS DOUBLE) ELSE 0.0 END + least(n, 3) * CAST(0.08 AS DOUBLE), 6) AS score FROM l""",
    "layer_summary": f"""WITH {_TERMS}, {_CHUNKS}, {_GROUND}, n AS (
  SELECT 'document_tree' AS layer, (SELECT count(DISTINCT lang) FROM documents) + (SELECT count(*) FROM documents) + (SELECT count(*) FROM chunks) AS n
  UNION ALL SELECT 'concept_kg', (SELECT count(DISTINCT name) FROM terms)
  UNION ALL SELECT 'evidence_graph', (SELECT count(*) FROM (SELECT DISTINCT chunk_id, quote FROM grounded))),
e AS (
  SELECT 'document_tree' AS layer, 2 * sum(c - 1) AS n FROM (SELECT doc_id, count(*) AS c FROM chunks GROUP BY ALL)
  UNION ALL SELECT 'evidence_graph', (SELECT count(*) FROM grounded)),
dim AS (SELECT * FROM (VALUES (0, 'document_tree', 'ready'), (1, 'concept_kg', 'ready'), (2, 'alias_alignment', 'reserved'), (3, 'evidence_graph', 'ready'),
  (4, 'integration_decision', 'reserved'), (5, 'teacher_edit', 'reserved'), (6, 'graphrag_retrieval', 'reserved')) t(layer_order, layer, status))
SELECT layer_order, layer, status, CAST(coalesce(n.n, 0) AS BIGINT) AS n_nodes, CAST(coalesce(e.n, 0) AS BIGINT) AS n_edges FROM dim LEFT JOIN n USING (layer) LEFT JOIN e USING (layer)""",
}
