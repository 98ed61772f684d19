"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, classifier, htmltext, licenses, linededup, mixing, ngramjoin, packing, pii, quality, topk, trie, urlfilter

#: A public tokenizer's file; a parameter of the packing query.
TOKENIZER = "word_bpe_49k.json"

# The URL rules of the query (verdict, host, path) and the terms of listed hosts.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
#: The registered query's key; a user gives one of their own.
SURROGATE_KEY = "surrogate-key"
LISTED_TERM = r"(^|[.-])(casino|bets|pills|ads|porn|xxx|warez)([.-]|$)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def listed_hosts(pages: DataFrame) -> DataFrame:
    """The list of this query: the hosts that have a listed term among their labels. Any other table does as well."""
    return pages.select(urlfilter.host(F.col("url")).alias("host")).where(F.col("host").rlike(LISTED_TERM)).distinct()


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = urlfilter.judge(pages, URL_RULES, listed_hosts(pages))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"), secret=SURROGATE_KEY)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "badness"
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (with a word), n_kept and the positions of removed lines."""
    gone = linededup.removals(table(spark, sf_dir, "documents"))
    return gone.select(F.col("_k").alias("doc_id"), "n_lines", (F.col("n_lines") - F.size("removed")).alias("n_kept"), "removed")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack(cut)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_exact_topk": op2_exact_topk,
    "op3_mix_sources": op3_mix_sources,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_html_text": op5_html_text,
    "op6_url_filter": op6_url_filter,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_quality_rules": op8_quality_rules,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_line_dedup": op10_line_dedup,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_filter_audit": op12_filter_audit,
    "op13_prefix_trie": op13_prefix_trie,
}

_HOST = "translate(regexp_extract(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '^[^/?#]*([^?#]*)', 1)"


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_BY_LENGTH = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))

ORACLE_SQL: dict[str, str] = {
    "op2_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op4_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS least FROM s UNION SELECT e.b, r.least FROM reach r JOIN e ON e.a = r.id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.least AS component_id FROM s JOIN (SELECT id, min(least) AS least FROM reach GROUP BY id) m ON m.id = s.doc_id
""",
    "op6_url_filter": f"""
WITH p AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages)
SELECT page_id, host, path,
  CASE {' '.join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in _BY_LENGTH)} END AS rule,
  CASE {' '.join(f"WHEN {_fits(h, p)} THEN '{v}'" for v, h, p in _BY_LENGTH)}
    WHEN regexp_matches(host, '{LISTED_TERM}') THEN 'block' ELSE 'allow' END AS verdict
FROM p
""",
    "op12_filter_audit": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), good AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN w.doc_id > first_id THEN 16 ELSE 0 END) AS failed,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN good ON good.doc_id = w.doc_id
), c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed),
o AS (
  SELECT '' AS before_letters, '' AS filter_order, 0 AS step, 0 AS before, 0 AS bit
  UNION ALL
  SELECT filter_order, filter_order || l, step + 1, before + bit, b FROM o, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(l, b)
  WHERE step < 5 AND NOT contains(filter_order, l)
), whole AS (SELECT filter_order FROM o WHERE step = 5),
steps AS (SELECT w.filter_order, o.step, o.before, o.bit FROM whole w JOIN o ON o.step > 0 AND starts_with(w.filter_order, o.filter_order)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN failed & before = 0 AND failed & bit = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed & before <> 0 AND failed & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
""",
    "op13_prefix_trie": r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, c - c % 5 AS base, (xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(8 * strlen(CAST(c AS VARCHAR))),
      lambda i: CAST((ascii(CAST(c AS VARCHAR)[i // 8 + 1]) >> CAST(i % 8 AS INT)) & 1 AS BIGINT))),
      lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)) % 9 AS h
  FROM (SELECT DISTINCT c FROM t)
), turns AS (
  SELECT ids.c, t.pos AS k, 0 AS own, t.r, t.x FROM ids JOIN t ON t.c = ids.base AND t.pos <= ids.h
  UNION ALL SELECT ids.c, t.pos, 1, t.r, t.x FROM ids JOIN t ON t.c = ids.c AND t.pos > ids.h
), seqs AS (
  SELECT ids.c, list({'r': turns.r, 'x': turns.x} ORDER BY own, k) FILTER (WHERE turns.c IS NOT NULL) AS s
  FROM ids LEFT JOIN turns ON turns.c = ids.c GROUP BY ids.c
), seq AS (SELECT c, coalesce(s, []) AS s FROM seqs),
pre AS (SELECT c, len(s) AS n, unnest(range(len(s) + 1)) AS d, s FROM seq),
marked AS (SELECT c, n, d, s, md5(CAST(s[1:d] AS VARCHAR) || d) AS node, md5(CAST(s[1:d - 1] AS VARCHAR) || (d - 1)) AS up FROM pre),
node AS (
  SELECT node, any_value(d) AS d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(strlen(s[d].x)) AS b,
    list(c ORDER BY c) FILTER (WHERE n = d) AS ends
  FROM marked GROUP BY node
), kids AS (SELECT up, count(*) AS n FROM node WHERE d > 0 GROUP BY up),
full_node AS (
  SELECT a.*, p.conv_id AS parent, coalesce(kids.n, 0) AS n_children, CASE WHEN a.d = 0 THEN 0 ELSE (a.n_convs - 1) * a.b END AS saved
  FROM node a LEFT JOIN node p ON p.node = a.up AND a.d > 0 LEFT JOIN kids ON kids.up = a.node
), above AS (
  SELECT u.node AS low, m.node AS high FROM full_node u JOIN marked m ON m.c = u.conv_id AND m.d <= u.d
), sums AS (
  SELECT high, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum(u.saved) AS saved FROM above JOIN full_node u ON u.node = above.low GROUP BY high
)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, f.parent AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(array_to_string(f.ends, ','), '')) AS ends_sha256
FROM full_node f JOIN sums s ON s.high = f.node
""",
}
