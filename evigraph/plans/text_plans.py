"""Queries on text: segmentation, tokens, the index and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import LATIN
from ..operators import chunking as C
from ..operators import index as I
from ..operators.scratch import Tables, shared_folder
from ..operators.store import Store
from .tables import table

#: Lines of at most so many characters open a section in these queries, as the texts have no marks.
SHORT_LINE = 24
#: Files that the search of the stored index is about.
SCOPE = ["src0", "src3", "src5", "src8", "src13"]


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    out = C.chunks(_docs(spark, sf), ("doc_id", "lang"))
    return out.withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_no"))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return C.line_records(_docs(spark, sf))


def _short_heading():
    return F.when((F.trim("line") != "") & (F.length(F.trim("line")) <= SHORT_LINE), F.lit(2))


def doc_sections(spark: SparkSession, sf: str) -> DataFrame:
    lines = C.draft_sections(C.line_records(_docs(spark, sf)), _short_heading())
    out = C.compose_sections(lines)
    return out.select("doc_id", "section_no", "title", T.quote_hash(F.col("content")).alias("quote_hash"), "line_start", "line_end", "char_count")


def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("doc_id", "chunk_no", "char_start", "char_end", "char_count", T.quote_hash(F.col("chunk")).alias("quote_hash"))


def chunk_locators(spark: SparkSession, sf: str) -> DataFrame:
    spans = C.line_spans(C.line_records(_docs(spark, sf)))
    composed = spans.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return C.locate(C.chunks(composed), spans)


def token_tf(spark: SparkSession, sf: str) -> DataFrame:
    return I.term_counts(_docs(spark, sf), "doc_id", "text")


def term_df(spark: SparkSession, sf: str) -> DataFrame:
    return I.document_frequencies(token_tf(spark, sf))


def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    counts = _chunks(spark, sf).select("lang", "chunk_id", F.size(T.tokens(F.col("chunk"))).alias("dl"))
    return counts.rollup("lang").agg(F.count("*").alias("n_chunks"), F.round(F.avg(F.when(F.col("dl") > 0, F.col("dl"))), 4).alias("avgdl"))


def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    out = I.hash_embedding(token_tf(spark, sf), "doc_id", digits=None)
    return out.select("doc_id", "bucket", F.round("w", 5).alias("w")).where("w <> 0")


def _scored(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return I.score(_questions(spark, sf), _chunks(spark, sf), LATIN, k=k)


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    scored = I.score(_questions(spark, sf), _chunks(spark, sf), LATIN, vectors=False, k=5)
    return I.top_k(scored, 5).select("question_id", "chunk_id", "rank", F.round("bm25", 4).alias("bm25"), F.round("coverage", 4).alias("coverage"))


def stored_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Search of five files in a stored index: built in two batches, then every seventh document goes, and half of these come again."""
    chunks = C.chunks(_docs(spark, sf), ("doc_id", "source")).withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_no"))
    store = Store(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    for part in ("doc_id % 3 = 0", "doc_id % 3 <> 0"):
        store.add(chunks.where(part), "chunk_id", "source", "chunk")
    store.remove(chunks.where("doc_id % 7 = 0"), "chunk_id")
    store.add(chunks.where("doc_id % 14 = 0"), "chunk_id", "source", "chunk")
    out = store.search(_questions(spark, sf), LATIN, 5, SCOPE)
    return out.select("question_id", F.col("key").alias("chunk_id"), "rank", F.round("bm25", 4).alias("bm25"), F.round("coverage", 4).alias("coverage"))


def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    out = I.top_k(_scored(spark, sf, 5), 5)
    return out.select("question_id", "chunk_id", "rank", F.round("score", 4).alias("score"), F.round("vector", 4).alias("vector"), "relevance")


def refusal_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Part names asked of the index of benchmark passages: those without grounds, and why."""
    turns = table(spark, sf, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_name").alias("question"))
    passages = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("chunk_id"), F.col("text").alias("chunk"))
    best = I.score(turns, passages, LATIN)
    return I.refusals(turns, I.query_terms(turns, "question_id", "question", LATIN), best, "question_id")


def best_quote(spark: SparkSession, sf: str) -> DataFrame:
    questions = _questions(spark, sf)
    chunks = _chunks(spark, sf)
    # a table of few rows, so that chunks are not dealt by key to meet it
    best = Tables(spark).write("best", I.top_k(_scored(spark, sf, 1), 1).select("question_id", "chunk_id"))
    top = best.join(chunks.select("chunk_id", "chunk"), "chunk_id")
    # sentences of this pack end with a stop
    said = top.withColumn("chunk", F.regexp_replace("chunk", r"\.", "；")).join(questions, "question_id")
    return I.best_quote(said, I.query_terms(questions, "question_id", "question", LATIN), "question_id", "chunk_id", "chunk", question="question", markers=LATIN.quote_markers)


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return I.vector_top_k(vectors.where("vec_id % 20 = 0"), vectors, 5, "vec_id", "embedding")


def locator_coverage(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    share = lambda c: F.round(F.avg(c.cast("int")), 4)
    return docs.groupBy("lang").agg(
        share(F.col("text").isNotNull()).alias("text"), share(F.col("quality").isNotNull()).alias("labelled"), share(F.col("text").contains("\n")).alias("line"), share(F.col("text").contains(" | ")).alias("sheet_row")
    )


def repeated_header_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    lines = C.line_records(docs).join(docs.select("doc_id", "source"), "doc_id")
    repeated = C.repeated_edge_lines(lines, "doc_id", "source")
    return C.filter_repeated(lines, repeated, "doc_id", "source").groupBy("source", "doc_id").agg(F.count("*").alias("n_lines"))


def row_windows_40(spark: SparkSession, sf: str) -> DataFrame:
    return C.row_windows(table(spark, sf, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"])


def file_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    return docs.select("doc_id", T.stable_id("raw", F.col("source"), F.col("doc_id"), F.col("lang")).alias("raw_id"), F.sha2("text", 256).alias("sha256"), T.quote_hash(T.collapse(F.substring("text", 1, 80))).alias("quote_hash"))


def sentence_stats(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.regexp_replace("text", r"\.", "；")
    said = _docs(spark, sf).select("doc_id", F.explode(T.sentences(marked)).alias("sentence"))
    return said.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("sentence")).alias("longest"))


def truncated_text(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.truncate(F.col("text"), 48).alias("brief"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_lines, doc_sections, doc_chunks, chunk_locators, token_tf, term_df, index_stats, hash_embedding, bm25_topk, stored_topk, hybrid_topk, refusal_gate,
        best_quote, vector_topk, locator_coverage, repeated_header_filter, row_windows_40, file_ids, sentence_stats, truncated_text,
    )
}

_LINES = """lines AS (
  SELECT doc_id, CAST(i AS INTEGER) AS line_no, rtrim(l) AS line FROM (
    SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i
    FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM documents))
)"""
_SPANS = """spans AS (
  SELECT doc_id, line_no, trim(line) AS line,
    coalesce(sum(length(trim(line)) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start
  FROM lines WHERE trim(line) <> ''
)"""


def _windows(source: str, keys: str) -> str:
    """Chunk windows of a table with text."""
    return f"""SELECT * FROM (
  SELECT {keys}, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(chunk_no * 620 AS INTEGER) AS char_start,
    CAST(least(chunk_no * 620 + 700, length(text)) AS INTEGER) AS char_end,
    regexp_replace(substring(text, CAST(chunk_no * 620 + 1 AS BIGINT), 700), '^\\s+|\\s+$', '', 'g') AS chunk
  FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil((length(text) - 80) / 620.0) AS BIGINT)))) AS chunk_no FROM {source} WHERE length(text) > 0)
) WHERE length(chunk) > 0"""


_CHUNKS = f"chunks AS (SELECT *, doc_id || '-' || chunk_no AS chunk_id FROM ({_windows('documents', 'doc_id, lang')}))"


def _tokens(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[a-zA-Z0-9_]{{2,}}')"


def _tf(name: str, source: str, key: str, text: str) -> str:
    return f"{name} AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({_tokens(text)}) AS term FROM {source}) GROUP BY ALL)"


_BUCKET = "CAST('0x' || substring(sha256(term), 15, 2) AS INTEGER)"
_SIGN = "CASE WHEN CAST('0x' || substring(sha256(term || ':sign'), 16, 1) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END"


def _vector(name: str, tf: str, key: str, digits: int | None = 6) -> str:
    w = "CASE WHEN norm > 0 THEN v / norm ELSE v END"
    w = f"round({w}, {digits})" if digits is not None else w
    return f"""{name} AS (
  SELECT {key}, bucket, {w} AS w FROM (
    SELECT *, sqrt(sum(v * v) OVER (PARTITION BY {key})) AS norm FROM (
      SELECT {key}, {_BUCKET} AS bucket, sum({_SIGN} * tf) / max(total) AS v
      FROM (SELECT *, sum(tf) OVER (PARTITION BY {key}) AS total FROM {tf}) GROUP BY ALL))
)"""


def _rag(questions: str, chunks: str) -> str:
    """CTEs up to `scored` for a table of (question_id, question) and one of (chunk_id, chunk)."""
    return f"""{_tf('ctf', chunks, 'chunk_id', 'chunk')},
{_tf('qraw', questions, 'question_id', 'question')},
qmark AS (SELECT *, contains(term, 'ingthe') AS stop, sum(CASE WHEN contains(term, 'ingthe') THEN 0 ELSE 1 END) OVER (PARTITION BY question_id) AS kept FROM qraw),
qtf AS (SELECT question_id, term, tf FROM qmark WHERE NOT stop OR kept = 0),
qsum AS (SELECT question_id, sum(tf) AS qsum FROM qtf GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM ctf GROUP BY ALL),
dls AS (SELECT chunk_id, sum(tf) AS dl FROM ctf GROUP BY ALL),
stats AS (SELECT (SELECT count(*) FROM {chunks}) AS n, (SELECT coalesce(avg(dl), 0.0) FROM dls) AS avgdl),
hits AS (
  SELECT question_id, chunk_id, term, max(qc) AS qc, max(tf) AS tf, bool_or(lit) AS lit FROM (
    SELECT question_id, chunk_id, term, qtf.tf AS qc, ctf.tf AS tf, false AS lit FROM qtf JOIN ctf USING (term)
    UNION ALL SELECT question_id, chunk_id, term, qtf.tf, 0, true FROM qtf JOIN {chunks} c ON length(term) >= 3 AND contains(c.chunk, term)
  ) GROUP BY ALL),
lex AS (
  SELECT question_id, chunk_id, sum(qc) AS matched, sum(
    ln(1 + (n - coalesce(df, 1) + 0.5) / (coalesce(df, 1) + 0.5))
    * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(coalesce(dl, 0), 1) / CASE WHEN avgdl > 0 THEN avgdl ELSE 1.0 END))) * qc
    + CASE WHEN lit THEN 2.0 ELSE 0.0 END) AS bm25
  FROM hits LEFT JOIN dfs USING (term) LEFT JOIN dls USING (chunk_id), stats GROUP BY ALL),
gated AS (SELECT question_id, chunk_id, bm25, matched / greatest(qsum, 1) AS coverage FROM lex JOIN qsum USING (question_id) WHERE matched / greatest(qsum, 1) >= 0.12),
{_vector('cvec', 'ctf', 'chunk_id')},
{_vector('qvec', 'qtf', 'question_id')},
dots AS (SELECT g.question_id, g.chunk_id, sum(c.w * q.w) AS dot FROM gated g JOIN cvec c USING (chunk_id) JOIN qvec q ON q.question_id = g.question_id AND q.bucket = c.bucket GROUP BY ALL),
scored AS (
  SELECT * FROM (SELECT question_id, chunk_id, bm25, coverage, greatest(0.0, coalesce(dot, 0.0)) AS vector, bm25 + 2.0 * greatest(0.0, coalesce(dot, 0.0)) AS score
  FROM gated LEFT JOIN dots USING (question_id, chunk_id)) WHERE score > 0)"""


_QUESTIONS = "questions AS (SELECT item_id AS question_id, text AS question FROM benchmark)"
_RAG = f"WITH {_CHUNKS}, {_QUESTIONS}, {_rag('questions', 'chunks')}"


def _ranked(score: str, k: int) -> str:
    return f"""ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round({score}, 6) DESC, round(bm25, 6) DESC, chunk_id) AS INTEGER) AS rank FROM scored
  QUALIFY rank <= {k})"""


_EDGE = """pages AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY ALL),
body AS (
  SELECT source, doc_id, line_no, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r, count(*) OVER (PARTITION BY doc_id) AS n
  FROM lines JOIN (SELECT doc_id, source FROM documents) USING (doc_id) WHERE trim(line) <> ''),
rep AS (
  SELECT source, line FROM (SELECT source, line, count(*) AS c FROM (SELECT DISTINCT source, doc_id, line FROM body WHERE length(line) <= 40 AND (r <= 2 OR r > n - 2)) GROUP BY ALL)
  JOIN pages USING (source) WHERE c >= greatest(3, floor(pages / 4)))"""

_WANTED = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(question, {chr(39)}{a}{chr(39)})' for a in asked)} THEN {list(said)}" for asked, said in LATIN.quote_markers) + " ELSE [] END"

ORACLE_SQL = {
    "doc_lines": f"WITH {_LINES} SELECT * FROM lines",
    "doc_sections": f"""WITH {_LINES}, marked AS (
  SELECT *, trim(line) <> '' AND length(trim(line)) <= {SHORT_LINE} AS head FROM lines
), numbered AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM marked),
body AS (
  SELECT doc_id, section_no, string_agg(trim(line), chr(10) ORDER BY line_no) AS content, min(line_no) AS line_start, max(line_no) AS line_end
  FROM numbered WHERE NOT head AND trim(line) <> '' GROUP BY ALL)
SELECT b.doc_id, CAST(b.section_no AS BIGINT) AS section_no, trim(h.line) AS title, substring(sha256(content), 1, 16) AS quote_hash, line_start, line_end, CAST(length(content) AS INTEGER) AS char_count
FROM body b LEFT JOIN (SELECT * FROM numbered WHERE head) h ON h.doc_id = b.doc_id AND h.section_no = b.section_no""",
    "doc_chunks": f"WITH {_CHUNKS} SELECT doc_id, chunk_no, char_start, char_end, CAST(length(chunk) AS INTEGER) AS char_count, substring(sha256(chunk), 1, 16) AS quote_hash FROM chunks",
    "chunk_locators": f"""WITH {_LINES}, {_SPANS}, composed AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM spans GROUP BY ALL),
w AS ({_windows('composed', 'doc_id')})
SELECT w.doc_id, w.chunk_no, min(line_no) AS line_start, max(line_no) AS line_end, count(*) AS n_lines
FROM w JOIN spans s ON s.doc_id = w.doc_id AND s.char_start < w.char_end AND s.char_start + length(s.line) > w.char_start GROUP BY ALL""",
    "token_tf": f"WITH {_tf('tf', 'documents', 'doc_id', 'text')} SELECT * FROM tf",
    "term_df": f"WITH {_tf('tf', 'documents', 'doc_id', 'text')} SELECT term, count(*) AS df FROM tf GROUP BY ALL",
    "index_stats": f"WITH {_CHUNKS} SELECT lang, count(*) AS n_chunks, round(avg(CASE WHEN dl > 0 THEN dl END), 4) AS avgdl FROM (SELECT lang, len({_tokens('chunk')}) AS dl FROM chunks) GROUP BY ROLLUP (lang)",
    "hash_embedding": f"WITH {_tf('tf', 'documents', 'doc_id', 'text')}, {_vector('vec', 'tf', 'doc_id', None)} SELECT doc_id, bucket, round(w, 5) AS w FROM vec WHERE round(w, 5) <> 0",
    "bm25_topk": f"{_RAG}, {_ranked('bm25', 5)} SELECT question_id, chunk_id, rank, round(bm25, 4) AS bm25, round(coverage, 4) AS coverage FROM ranked",
    "stored_topk": f"""WITH final_docs AS (SELECT * FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 14 = 0),
chunks AS (SELECT *, doc_id || '-' || chunk_no AS chunk_id FROM ({_windows('final_docs', 'doc_id, source')})), {_QUESTIONS}, {_rag('questions', 'chunks')}
SELECT question_id, chunk_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(bm25, 6) DESC, chunk_id) AS INTEGER) AS rank, round(bm25, 4) AS bm25, round(coverage, 4) AS coverage
FROM scored JOIN (SELECT chunk_id, source FROM chunks) USING (chunk_id) WHERE source IN ({', '.join(f"'{x}'" for x in SCOPE)}) QUALIFY rank <= 5""",
    "hybrid_topk": f"""{_RAG}, {_ranked('score', 5)} SELECT question_id, chunk_id, rank, round(score, 4) AS score, round(vector, 4) AS vector,
  round(least(1.0, score / max(score) OVER (PARTITION BY question_id)), 4) AS relevance FROM ranked""",
    "refusal_gate": f"""WITH turns AS (SELECT p_partkey AS question_id, p_name AS question FROM part),
passages AS (SELECT CAST(item_id AS VARCHAR) AS chunk_id, text AS chunk FROM benchmark),
{_rag('turns', 'passages')}
SELECT question_id, CASE WHEN question_id IN (SELECT question_id FROM qtf) THEN 'no_grounded_match' ELSE 'query_has_no_terms' END AS reason
FROM turns WHERE question_id NOT IN (SELECT question_id FROM scored)""",
    "best_quote": f"""{_RAG}, {_ranked('score', 1)}, said AS (
  SELECT question_id, chunk_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM (
    SELECT question_id, chunk_id, list_filter(list_transform(regexp_extract_all(replace(chunk, '.', '；'), '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s
    FROM ranked JOIN chunks USING (chunk_id))
), counted AS (
  SELECT s.question_id, chunk_id, sentence, pos, 5 * (SELECT count(*) FROM qtf q WHERE q.question_id = s.question_id AND contains(s.sentence, q.term))
    + 2 * len(list_filter({_WANTED}, lambda m: contains(s.sentence, m))) AS hits FROM said s JOIN questions USING (question_id))
SELECT question_id, chunk_id, substring(sentence, 1, 180) AS quote FROM counted
QUALIFY row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY hits DESC, pos) = 1""",
    "vector_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT q.vec_id AS query_id, c.vec_id AS vec_id, round(greatest(0.0, list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v)))), 6) AS cosine,
  CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY cosine DESC, c.vec_id) AS INTEGER) AS rank
FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id QUALIFY rank <= 5""",
    "locator_coverage": """SELECT lang, round(avg(CAST(text IS NOT NULL AS INTEGER)), 4) AS text, round(avg(CAST(quality IS NOT NULL AS INTEGER)), 4) AS labelled,
  round(avg(CAST(contains(text, chr(10)) AS INTEGER)), 4) AS line, round(avg(CAST(contains(text, ' | ') AS INTEGER)), 4) AS sheet_row
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""",
    "repeated_header_filter": f"""WITH {_LINES}, {_EDGE}
SELECT source, doc_id, count(*) AS n_lines FROM body b
WHERE NOT ((r <= 2 OR r > n - 2) AND EXISTS (SELECT 1 FROM rep WHERE rep.source = b.source AND rep.line = b.line)) GROUP BY ALL""",
    "row_windows_40": """SELECT l_suppkey, CAST((rn - 1) // 40 AS INTEGER) AS window_no, CAST(min(rn) AS INTEGER) AS row_start, CAST(max(rn) AS INTEGER) AS row_end, count(*) AS n_rows
FROM (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) GROUP BY ALL""",
    "file_ids": """SELECT doc_id, 'raw_' || substring(sha256(source || '|' || doc_id || '|' || lang), 1, 16) AS raw_id, sha256(text) AS sha256,
  substring(sha256(trim(regexp_replace(substring(text, 1, 80), '\\s+', ' ', 'g'))), 1, 16) AS quote_hash FROM documents""",
    "sentence_stats": """SELECT doc_id, count(*) AS n_sentences, CAST(max(length(s)) AS INTEGER) AS longest FROM (
  SELECT doc_id, regexp_replace(unnest(regexp_extract_all(replace(text, '.', '；'), '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$')), '^\\s+|\\s+$', '', 'g') AS s FROM documents) WHERE s <> '' GROUP BY ALL""",
    "truncated_text": """SELECT doc_id, CASE WHEN length(text) <= 48 THEN text ELSE regexp_replace(substring(text, 1, 47), '[ ，,；;。]+$', '') || '…' END AS brief FROM documents""",
}
