"""Operators on small fixtures of our own: the Chinese pack, edge cases, streaming and sources."""

import random

from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.functions.lexicon import ZH_MEDICAL
from evigraph.operators import align, ask, chunking, graph, index, integrate
from evigraph.operators.components import connected_components


def test_cjk_tokens(spark):
    row = spark.createDataFrame([("细胞损伤 ATP a",)], "t string").select(T.tokens(F.col("t")).alias("x")).first()
    assert row.x == ["atp", "细胞", "胞损", "损伤", "细胞损", "胞损伤", "细胞损伤"]


def test_sentences_keep_their_marks(spark):
    row = spark.createDataFrame([("甲是乙。丙；  丁!",)], "t string").select(T.sentences(F.col("t")).alias("x")).first()
    assert row.x == ["甲是乙。", "丙；", "丁!"]


def test_intents_in_order(spark):
    asked = ["为什么合并甲", "甲与乙的区别", "学甲前要先学什么", "哪些教材讲甲", "甲和乙的关系", "甲是什么", "甲"]
    df = spark.createDataFrame([(q,) for q in asked], "q string").select(ask.intent(F.col("q"), ZH_MEDICAL).alias("i"))
    assert [r.i for r in df.collect()] == ["decision_review", "comparison", "prerequisite", "coverage", "relation_path", "definition", "hybrid"]


def test_terms_are_cleaned_and_filtered(spark):
    df = spark.createDataFrame([("第一章 细胞损伤", "炎症反应（inflammation）是指机体的反应。可导致细胞死亡。本书介绍")], "title string, t string")
    terms = df.select(graph.candidate_terms(F.col("title"), F.col("t"), ZH_MEDICAL, 8).alias("x")).first().x
    assert terms[0] == "细胞损伤" and "炎症反应" in terms and "细胞死亡" in terms
    assert not any("本书" in t for t in terms)


def test_chunk_windows_match_a_loop(spark):
    texts = [(i, "x" * n) for i, n in enumerate((1, 79, 80, 81, 700, 701, 1320, 1321, 5000))]
    got = chunking.chunks(spark.createDataFrame(texts, "doc_id long, text string")).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    for r in got:
        n, start, count = len(texts[r.doc_id][1]), 0, 0
        while True:
            count += 1
            if start + 700 >= n:
                break
            start += 620
        assert r.n == count, n


def test_empty_and_null_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  \n ")], "doc_id long, text string")
    assert chunking.chunks(df).count() == 0
    assert index.term_counts(df, "doc_id", "text").count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200, 260)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e}


def test_eviction_matches_the_loop(spark):
    rng = random.Random(5)
    rows = [("g", i, rng.randrange(1, 49), round(rng.random() * 5, 2), rng.random() < 0.7) for i in range(60)]
    limit = 500
    left, gone = sum(r[2] for r in rows), set()
    for r in sorted((r for r in rows if r[4]), key=lambda r: (r[3], r[1])):
        if left <= limit:
            break
        left -= r[2]
        gone.add(r[1])
    df = spark.createDataFrame(rows, "g string, id int, need int, importance double, evictable boolean")
    out = integrate.evict(df, spark.createDataFrame([("g", limit)], "g string, limit long"), "g", ["importance", "id"])
    assert {r.id for r in out.where("evicted").collect()} == gone


def test_conflict_and_alias_relations(spark):
    nodes = spark.createDataFrame(
        [(1, "a", "抗体", "抗体是蛋白", "免疫", [], ["x"]), (2, "b", "抗体", "抗体不是酶", "免疫", [], ["x"]), (3, "b", "antibody", "蛋白", "免疫", ["抗体"], ["x"])],
        "node_id long, book string, name string, definition string, context string, extra_aliases array<string>, neighbours array<string>",
    )
    feats = align.features(nodes, {"antibody": "抗体"})
    out = align.candidates(align.signals(align.candidate_pairs(feats), feats), ZH_MEDICAL.negative, ZH_MEDICAL.positive)
    found = {(r.l, r.r): r.relation for r in out.collect()}
    assert found[(1, 2)] == "CONFLICTS_WITH" and found[(1, 3)] == "ALIAS_OF"


def test_override_keeps_content_without_one(spark):
    base = spark.createDataFrame([(1, "keep", 0.5, "old"), (2, "keep", 0.5, "old")], "id long, action string, confidence double, content string")
    edits = spark.createDataFrame([(1, 1, "merge", 0.9, "x"), (1, 2, "remove", 0.8, None)], "id long, seq long, action string, confidence double, content string")
    got = {r.id: (r.action, r.content, r.edited) for r in integrate.apply_overrides(base, edits, "id").collect()}
    assert got == {1: ("remove", "old", True), 2: ("keep", "old", False)}


def test_file_sources(spark, tmp_path):
    from evigraph.sources import files

    (tmp_path / "a.md").write_text("# 第一章\n正文\n", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("中文文本".encode("gb18030"))
    (tmp_path / "c.csv").write_text("name;value\n" + "".join(f"r{i};{i}\n" for i in range(45)))
    (tmp_path / "d.doc").write_bytes(b"x")
    raw = files.raw_files(spark, str(tmp_path))
    assert {r.filename: r.text for r in files.text_documents(raw).collect()} == {"a.md": "# 第一章\n正文\n", "b.txt": "中文文本"}
    windows = sorted(files.sheet_windows(files.sheet_rows(raw)).collect(), key=lambda r: r.window_no)
    assert [(r.row_start, r.row_end) for r in windows] == [(2, 41), (42, 46)] and windows[1].text.startswith("| name | value |\n| --- | --- |\n| r40 | 40 |")
    assert [r.filename for r in files.rejects(raw).collect()] == ["d.doc"]


def test_edit_stream_appends_once(spark, tmp_path):
    from evigraph.streaming import edits

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(f'{{"decision_id": "d", "seq": {i}, "at": "2024-01-01T00:00:0{i}Z", "action": "keep", "confidence": 0.5}}\n')
    for _ in range(2):
        edits.append_log(edits.edit_stream(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 3 and edits.latest_edits(log).first().n_edits == 3
