"""Deep section trees, term rules, markers of quotes, shrink passes, uploads and the stored index on small fixtures."""

import hashlib
import random

from pyspark.sql import functions as F

from evigraph.functions.lexicon import LATIN, ZH_MEDICAL
from evigraph.operators import context, graph, index, integrate, uploads
from evigraph.operators.store import Store


def test_section_tree_of_forty_levels(spark):
    rows = [(str(i), str(i - 1) if i else None, 10**9 + i) for i in range(40)] + [("x", "nowhere", 5), ("y", "z", 1), ("z", "y", 1)]
    out = {r.id: (r.depth, list(r.path)) for r in context.section_tree(spark.createDataFrame(rows, "id string, parent string, seq long")).collect()}
    assert out == {str(i): (i, [10**9 + k for k in range(i + 1)]) for i in range(40)} | {"x": (0, [5])}


def test_terms_that_read_like_sentences_are_no_names(spark):
    names = ["细胞研究进行", "细胞的研究进行了很久", "甲的乙的丙丁戊己庚辛", "甲的乙的丙", "细胞损伤"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(graph.good_term(F.col("n"), ZH_MEDICAL).alias("g"))
    assert [r.g for r in df.collect()] == [True, False, True, True, True]
    longer = spark.createDataFrame([("甲的乙的丙丁戊己庚辛壬",)], "n string").select(graph.good_term(F.col("n"), ZH_MEDICAL).alias("g"))
    assert not longer.first().g


def test_quotes_are_ranked_by_terms_then_markers(spark):
    pairs = spark.createDataFrame([(1, "c", "学习甲前要先学什么", "甲很大。乙是甲的基础。丙。"), (2, "c", "甲", "甲很大。乙是甲的基础。")], "q long, k string, question string, t string")
    terms = spark.createDataFrame([(1, "甲"), (2, "甲")], "q long, term string")
    out = index.best_quote(pairs, terms, "q", "k", "t", question="question", markers=ZH_MEDICAL.quote_markers)
    assert {r.q: r.quote for r in out.collect()} == {1: "乙是甲的基础。", 2: "甲很大。"}


def shorter(text, n):
    return text if len(text) <= n else text[: n - 1].rstrip(" ，,；;。") + "…"


def test_shrink_passes_match_a_walk(spark):
    rng = random.Random(16)
    drafts = [(g, i, "".join(rng.choice("甲乙，。x") for _ in range(rng.randrange(0, 60)))) for g in "abc" for i in range(40)]
    limits = {"a": 700, "b": 200, "c": 10**6}
    df = spark.createDataFrame(drafts, "g string, i long, t string")
    out = integrate.shrink(df, spark.createDataFrame(list(limits.items()), "g string, limit long"), "g", ["i"], "t")
    got = {(r.g, r.i): r.t for r in out.collect()}
    for g, limit in limits.items():
        own = [[i, t] for x, i, t in drafts if x == g]
        over = sum(len(t) for _, t in own) - limit
        for floor in (12, 1):
            for d in reversed(own):
                give = min(max(0, len(d[1]) - floor), max(0, over))
                if give:
                    d[1] = shorter(d[1], len(d[1]) - give)
                    over -= give
        assert {i: t for i, t in own} == {i: got[g, i] for i, _ in own}


def test_uploads_are_judged_and_assembled(spark):
    sessions = [("a", 7, 2, 4, None), ("b", 8, 2, 4, None), ("c", 4, 1, 4, "00"), ("d", 3, 1, 4, hashlib.sha256(b"xyz").hexdigest().upper()), ("e", 9, 2, 4, None)]
    parts = [("a", 0, 1, b"....") , ("a", 0, 2, b"1234"), ("a", 1, 1, b"567"), ("b", 0, 1, b"12"), ("b", 1, 1, b"5678"), ("b", 2, 1, b"x"), ("b", -1, 1, b"x"), ("c", 0, 1, b"abcd"), ("c", 0, 2, b""), ("d", 0, 1, b"xyz"), ("e", 0, 1, b"1234"), ("e", 1, 1, b"12345"), ("gone", 0, 1, b"x")]
    s = spark.createDataFrame(sessions, "session_id string, total_bytes long, total_parts int, part_bytes int, sha256 string")
    p = spark.createDataFrame(parts, "session_id string, part_no int, seq int, content binary")
    assert sorted(r.error for r in uploads.judged_parts(s, p).where("error is not null").collect()) == ["empty", "index", "index", "size", "too_large"]
    out = {r.session_id: (r.status, r.n_missing, r.progress, r.digest) for r in uploads.assemble(s, p).collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert out == {"a": ("assembled", 0, 100, digest(b"1234567")), "b": ("missing", 1, 50, None), "c": ("sha256_mismatch", 0, 100, None), "d": ("assembled", 0, 100, digest(b"xyz")), "e": ("missing", 1, 44, None)}


def test_stored_index_equals_a_fresh_one(spark, tmp_path):
    rng = random.Random(17)
    words = [f"word{i}" for i in range(30)] + ["wordy", "the"]
    texts = {f"k{i}": (f"f{i % 3}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for i in range(60)}
    rows = lambda keys: spark.createDataFrame([(k, *texts[k]) for k in keys], "key string, file string, text string")
    keys = list(texts)
    store = Store(spark, f"file://{tmp_path}/index")
    store.add(rows(keys[:30]), "key", "file", "text")
    store.remove(rows(keys[:10] + keys[50:]), "key")
    store = Store(spark, f"file://{tmp_path}/index")  # opened again
    for k in keys[:5]:
        texts[k] = ("f1", "word1 changed word2")
    store.add(rows(keys[30:] + keys[:5]), "key", "file", "text")
    live = keys[:5] + keys[10:]
    questions = spark.createDataFrame([(1, "word1 word2 the"), (2, "ord3 word3 word4 word9"), (3, "nothing")], "question_id long, question string")
    fresh = index.score(questions, rows(live).select(F.col("key").alias("chunk_id"), F.col("text").alias("chunk")), LATIN, vectors=False)
    best = {}
    for r in fresh.collect():
        if texts[r.chunk_id][0] != "f2":
            best.setdefault(r.question_id, []).append((-round(r.bm25, 6), r.chunk_id))
    got = {}
    for r in sorted(store.search(questions, LATIN, 7, ["f0", "f1"]).collect(), key=lambda r: r.rank):
        got.setdefault(r.question_id, []).append((-round(r.bm25, 6), r.key))
    assert got == {q: sorted(v)[:7] for q, v in best.items()} and set(got) == {1, 2}
