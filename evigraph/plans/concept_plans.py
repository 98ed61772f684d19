"""Queries on the result of an integration.

Documents stand in for nodes, languages for reports: those that open with the same word are a cluster, neighbours by id
are candidates, and neighbours of one language whose quality labels differ are conflicts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import concepts as C
from ..operators.scratch import Tables
from .tables import table
from .text_plans import _tokens

#: Characters of a definition, neighbours compared, and the share of characters to keep.
CHARS, NEAR, RATIO = 200, 8, 0.005


class _Integration(NamedTuple):
    nodes: DataFrame
    candidates: DataFrame
    conflicts: DataFrame
    placed: DataFrame
    drafts: DataFrame
    originals: DataFrame


def _integration(spark: SparkSession, sf: str) -> _Integration:
    tables = Tables(spark)  # what several steps read is made once
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("group"), T.collapse(F.col("text")).alias("whole"))
    # whole texts stay where they are read: only openings and sizes are joined
    docs = docs.select("doc_id", "group", F.regexp_extract("whole", "^[^ ]*", 0).alias("name"), T.truncate(F.col("whole"), CHARS).alias("text"), F.length("whole").alias("size"))
    docs = tables.write("docs", tables.write("texts", docs).join(labels, "doc_id", "left"))
    nodes = docs.select(
        "group", F.col("doc_id").cast("string").alias("node_id"), "name", "text", (F.floor(F.col("size") / 100) / 10).alias("importance"),
        F.lit(1).alias("frequency"), F.when(F.col("quality") == 1, 0.8).otherwise(0.5).alias("confidence"), F.lit(1).alias("n_chunks"),
        F.when(F.col("toxic") == 1, 0).otherwise(1).alias("n_locators"), "size",
    )
    members = docs.select(F.concat_ws("|", "group", "name").alias("cluster"), F.col("doc_id").cast("string").alias("node_id"), F.col("doc_id").alias("pos"))
    clusters = docs.select(F.concat_ws("|", "group", "name").alias("cluster"), "name", F.lit(0.9).alias("confidence")).distinct()
    side = lambda p: docs.select(F.col("doc_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("group", "name", "quality")], F.col("size").alias(f"{p}_n"))
    near = side("l").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(NEAR)))).withColumn("r_id", F.col("l_id") + F.col("step")).join(side("r"), "r_id").where("l_group = r_group")
    long_, short = F.greatest("l_n", "r_n"), F.greatest(F.lit(1), F.least("l_n", "r_n"))
    relation = F.when((F.col("step") == 1) & (F.col("l_quality") != F.col("r_quality")), "CONFLICTS_WITH").when(F.col("l_name") == F.col("r_name"), F.when(long_ / short >= 1.55, "REFINES").otherwise("SAME_AS"))
    candidates = near.withColumn("relation", relation).where("relation is not null").select(
        F.concat_ws("-", "l_id", "r_id").alias("candidate"), F.col("l_id").cast("string").alias("l"), F.col("r_id").cast("string").alias("r"), "relation", F.lit(0.7).alias("confidence"),
        F.concat(F.col("l_id"), F.lit("/"), F.col("r_id"), F.lit(".")).alias("reason"), (F.col("l_id") * 100 + F.col("step")).alias("rank"),
    )
    candidates = tables.write("candidates", candidates)
    conflicts = tables.write("conflicts", C.conflicts(candidates, nodes))
    guarded = C.guarded_nodes(conflicts)
    placed = tables.write("placed", C.placed_members(nodes, members, candidates))
    drafts = C.cluster_drafts(placed, clusters, candidates, guarded).unionByName(C.single_drafts(nodes, placed, guarded))
    return _Integration(nodes, candidates, conflicts, placed, drafts, nodes.groupBy("group").agg(F.sum("size").alias("original")))


def _budgeted(it: _Integration) -> DataFrame:
    return C.within_budget(it.drafts, it.originals, RATIO)


def concept_drafts(spark: SparkSession, sf: str) -> DataFrame:
    return _integration(spark, sf).drafts.drop("n_chunks", "n_locators")


def redundant_members(spark: SparkSession, sf: str) -> DataFrame:
    return C.redundancies(_integration(spark, sf).placed)


def integrated_decisions(spark: SparkSession, sf: str) -> DataFrame:
    it = _integration(spark, sf)
    return C.decisions(_budgeted(it), it.conflicts)


def integrated_concepts(spark: SparkSession, sf: str) -> DataFrame:
    return C.concepts(_budgeted(_integration(spark, sf)))


def concept_decision_links(spark: SparkSession, sf: str) -> DataFrame:
    it = _integration(spark, sf)
    budgeted = _budgeted(it)
    return C.concept_decisions(C.concepts(budgeted), C.decisions(budgeted, it.conflicts), it.conflicts, C.draft_members(budgeted, it.placed))


def integration_totals(spark: SparkSession, sf: str) -> DataFrame:
    it = _integration(spark, sf)
    budgeted = _budgeted(it)
    return C.totals(C.concepts(budgeted), C.decisions(budgeted, it.conflicts), it.nodes, it.originals, RATIO)


QUERIES = {f.__name__: f for f in (concept_drafts, redundant_members, integrated_decisions, integrated_concepts, concept_decision_links, integration_totals)}


def _format(pattern: str, *values: str) -> str:
    """SQL: the wording with its values put in."""
    parts = pattern.split("%s")
    return " || ".join(x for p, v in zip(parts, (*values, "")) for x in (f"'{p}'" if p else "", v) if x)


def _cut(text: str, n: str) -> str:
    return f"CASE WHEN length({text}) <= {n} THEN {text} ELSE regexp_replace(substr({text}, 1, {n} - 1), '[ ，,；;。]+$', '') || '…' END"


def _id(prefix: str, parts: str) -> str:
    return f"'{prefix}_' || substr(sha256({parts}), 1, 16)"


W = C.ZH
_LONG = "CAST({} AS BIGINT)"
_DRAFTS = f"""docs AS (SELECT d.doc_id, coalesce(lang, '') AS g, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS whole, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
nodes AS (SELECT *, regexp_extract(whole, '^[^ ]*') AS name, {_cut('whole', str(CHARS))} AS text, floor(length(whole) / 100) / 10 AS imp, g || '|' || regexp_extract(whole, '^[^ ]*') AS cl,
  CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS loc FROM docs),
cand AS (SELECT l.doc_id AS l, r.doc_id AS r, l.cl AS lc, r.cl AS rc, l.g AS lg, l.loc + r.loc AS locs, l.doc_id || '/' || r.doc_id || '.' AS reason,
  CASE WHEN r.doc_id - l.doc_id = 1 AND l.quality <> r.quality THEN 'CONFLICTS_WITH' WHEN l.name = r.name THEN
    CASE WHEN greatest(length(l.whole), length(r.whole)) / greatest(1, least(length(l.whole), length(r.whole))) >= CAST(1.55 AS DOUBLE) THEN 'REFINES' ELSE 'SAME_AS' END END AS relation
  FROM nodes l, range(1, {NEAR + 1}) s(step), nodes r WHERE r.doc_id = l.doc_id + step AND l.g = r.g),
confl AS (SELECT *, {_id('integration_decision', "'conflict|' || l || '-' || r")} AS id FROM cand WHERE relation = 'CONFLICTS_WITH'),
guard AS (SELECT l AS doc_id FROM confl UNION SELECT r FROM confl),
reps AS (SELECT cl, first(doc_id) OVER w AS rep, first(name) OVER w AS rname, first(text) OVER w AS rtext, count(*) OVER (PARTITION BY cl) AS n,
  cl IN (SELECT lc FROM cand WHERE relation = 'REFINES' AND lc = rc) AS refines FROM nodes
  WINDOW w AS (PARTITION BY cl ORDER BY length(text) DESC, name, CAST(doc_id AS VARCHAR), text) QUALIFY row_number() OVER w = 1 AND n > 1),
placed AS (SELECT nodes.*, rep, rname, rtext, n, refines, list_distinct({_tokens('rtext')}) AS bt FROM nodes JOIN reps USING (cl)),
adds AS (SELECT cl, string_agg(text, ' ' ORDER BY doc_id) AS adds FROM (SELECT * FROM placed WHERE doc_id <> rep AND text <> ''
  AND (refines OR len(list_intersect(bt, list_distinct({_tokens('text')}))) < greatest(2, len(bt) // 5)) QUALIFY row_number() OVER (PARTITION BY cl ORDER BY doc_id) <= 2) GROUP BY cl),
said AS (SELECT lc AS cl, string_agg(reason, '；' ORDER BY l, r) AS said FROM (SELECT * FROM cand WHERE lc = rc AND relation IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lc ORDER BY l, r) <= 2) GROUP BY lc),
per AS (SELECT g, cl, any_value(name) AS name, any_value(rep) AS rep, any_value(rname) AS rname, any_value(rtext) AS rtext, any_value(refines) AS refines, count(*) AS n, round(sum(imp), 4) AS imp, sum(loc) AS loc,
  bool_or(doc_id IN (SELECT doc_id FROM guard)) AS guarded FROM placed GROUP BY g, cl),
drafts AS (
  SELECT g, cl AS draft, true AS clustered, CASE WHEN refines THEN 'refine' ELSE 'merge' END AS action, name, n, rep, CASE WHEN adds IS NULL THEN rtext ELSE {_format(W.supplement, 'rtext', 'adds')} END AS text, imp, CAST(0.9 AS DOUBLE) AS conf,
    guarded, guarded AS force_retain, CASE WHEN refines THEN {_format(W.refine_reason, 'name', 'rname', '(n - 1)', f"coalesce(said, '{W.refine_without}')")} ELSE {_format(W.merge_reason, 'name', 'rname', '(n - 1)', f"coalesce(said, '{W.merge_without}')")} END AS reason,
    n AS n_chunks, CAST(loc AS BIGINT) AS loc FROM per LEFT JOIN adds USING (cl) LEFT JOIN said USING (cl)
  UNION ALL
  SELECT g, CAST(doc_id AS VARCHAR), false, 'keep', name, 1, doc_id, text, imp, CASE WHEN quality = 1 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END, x, x OR imp >= 4.5,
    CASE WHEN x THEN {_format(W.guarded_reason, 'name')} ELSE {_format(W.keep_reason.replace('%.2f', '%s').replace('%d', '%s'), 'name', "printf('%.2f', imp)", "'1'")} END, 1, loc
  FROM (SELECT *, doc_id IN (SELECT doc_id FROM guard) AS x FROM nodes WHERE cl NOT IN (SELECT cl FROM reps)))"""
_BUDGETED = f"""{_DRAFTS}, lim AS (SELECT g, CAST(greatest(1, floor(sum(length(whole)) * CAST({RATIO} AS DOUBLE))) AS BIGINT) AS lim, sum(length(whole)) AS original, count(*) AS n_nodes FROM nodes GROUP BY g),
freed AS (SELECT d.*, lim, NOT clustered AND NOT force_retain AS free, sum(least(length(text), 48)) OVER (PARTITION BY g) AS total,
  coalesce(sum(CASE WHEN NOT clustered AND NOT force_retain THEN least(length(text), 48) ELSE 0 END) OVER (PARTITION BY g ORDER BY CASE WHEN NOT clustered AND NOT force_retain THEN 0 ELSE 1 END, imp, length(text), name, draft
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM drafts d JOIN lim USING (g)),
judged AS (SELECT *, free AND total - before > lim AS evicted FROM freed),
r AS (SELECT *, length(text) AS length, greatest(1.0, imp) AS w, row_number() OVER (PARTITION BY g ORDER BY imp DESC, name, clustered, draft) AS i, count(*) OVER (PARTITION BY g) AS m FROM judged WHERE NOT evicted),
tot AS (SELECT g, sum(w ORDER BY i) AS tw FROM r GROUP BY g),
f AS (
  SELECT g, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS chars, lim AS rest, tw AS wleft FROM lim JOIN tot USING (g)
  UNION ALL
  SELECT s.g, s.i, s.used, s.rest - s.used, s.wleft - s.w FROM (
    SELECT r.g, r.i, f.rest, f.wleft, r.w,
      CAST(least(greatest(1, CASE WHEN r.m = r.i THEN f.rest ELSE least(greatest(12, CAST(floor(f.rest * r.w / f.wleft) AS BIGINT)), f.rest - 12 * (r.m - r.i)) END), r.length) AS BIGINT) AS used
    FROM f JOIN r ON r.g = f.g AND r.i = f.i + 1) s),
done AS (SELECT r.* EXCLUDE (evicted), {_cut('text', 'chars')} AS definition FROM r JOIN f USING (g, i)),
budgeted AS (
  SELECT g, draft, clustered, action, name, n, conf, guarded, reason, n_chunks, loc, definition FROM done
  UNION ALL
  SELECT g, draft, clustered, 'remove', name, n, greatest({C.LEAST_CONFIDENCE}, least({C.MOST_CONFIDENCE}, conf)), guarded, {_format(W.remove_reason, 'name')}, n_chunks, loc, NULL FROM judged WHERE evicted),
decs AS (
  SELECT g, {_id('integration_decision', "action || '|' || CASE WHEN clustered THEN draft ELSE name || '|' || draft END")} AS decision_id, draft, CASE WHEN clustered THEN draft END AS cluster, action, definition AS content, reason,
    round(CAST(conf AS DOUBLE), 4) AS confidence, n AS n_targets, n_chunks, loc AS n_locators FROM budgeted
  UNION ALL
  SELECT lg, id, NULL, NULL, 'conflict', '{W.conflict_content}', {_format(W.conflict_reason, 'reason')}, CAST(0.7 AS DOUBLE), 2, 2, locs FROM confl),
decisions AS (SELECT *, n_locators > 0 AS complete FROM decs),
concepts AS (SELECT g, {_id('integrated_concept', "CASE WHEN clustered THEN draft ELSE name || '|' || draft END")} AS concept_id, draft, name, action, definition,
  CASE action WHEN 'merge' THEN {_format(W.merge_summary, 'name')} WHEN 'refine' THEN {_format(W.refine_summary, 'name')} ELSE {_format(W.keep_summary, 'name')} END AS summary, round(conf, 4) AS confidence, n AS n_members, guarded
  FROM budgeted WHERE action <> 'remove')"""

ORACLE_SQL = {
    "concept_drafts": f"WITH {_DRAFTS} SELECT g AS \"group\", draft, clustered, action, name, n AS n_members, CAST(rep AS VARCHAR) AS representative, text, imp AS importance, conf AS confidence, guarded, force_retain, reason FROM drafts",
    "redundant_members": f"""WITH {_DRAFTS} SELECT cl AS draft, CAST(doc_id AS VARCHAR) AS node_id, doc_id AS pos, CASE WHEN refines THEN '{W.redundant_refine}' ELSE '{W.redundant_merge}' END AS kind,
  name || ': ' || {_cut('text', str(C.REDUNDANT_CHARS))} AS detail FROM placed WHERE doc_id <> rep""",
    "integrated_decisions": f"WITH RECURSIVE {_BUDGETED} SELECT g AS \"group\", * EXCLUDE (g) FROM decisions",
    "integrated_concepts": f"WITH RECURSIVE {_BUDGETED} SELECT g AS \"group\", * EXCLUDE (g) FROM concepts",
    "concept_decision_links": f"""WITH RECURSIVE {_BUDGETED}, of AS (SELECT cl AS draft, doc_id FROM placed UNION ALL SELECT draft, CAST(draft AS BIGINT) FROM drafts WHERE NOT clustered)
SELECT concept_id, decision_id FROM concepts JOIN decisions USING (draft) UNION SELECT concept_id, id FROM confl JOIN of ON doc_id = l OR doc_id = r JOIN concepts USING (draft)""",
    "integration_totals": f"""WITH RECURSIVE {_BUDGETED}, k AS (SELECT g, count(*) AS n_concepts, {_LONG.format('sum(length(definition))')} AS retained FROM concepts GROUP BY g),
d AS (SELECT g, count(*) AS n_decisions, {', '.join(_LONG.format(f"coalesce(sum({v}) FILTER (action = '{a}'), 0)") + f' AS {name}' for a, v, name in (('merge', 'n_targets - 1', 'merged'), ('keep', 'n_targets', 'kept'), ('remove', 'n_targets', 'removed'), ('refine', 'greatest(1, n_targets - 1)', 'refined')))},
  count(*) FILTER (action = 'conflict') AS conflicts, count(*) FILTER (complete) AS complete FROM decisions GROUP BY g)
SELECT g AS "group", {_LONG.format('original')} AS original, n_nodes, coalesce(n_concepts, 0) AS n_concepts, coalesce(retained, 0) AS retained, n_decisions, merged, kept, removed, refined, conflicts, round(coalesce(retained, 0) / original, 4) AS ratio,
  round((n_nodes - coalesce(n_concepts, 0)) / n_nodes, 4) AS node_reduction, round(complete / n_decisions, 4) AS evidence_coverage, round(coalesce(retained, 0) / original, 4) <= CAST({RATIO} AS DOUBLE) AS target_met
FROM lim LEFT JOIN k USING (g) LEFT JOIN d USING (g)""",
}
