"""Grounds and answers on small cases, line by line."""

from evigraph.operators import replies as R
from evigraph.operators.ask import NO_ANSWER

ASKED = "question_id long, question string, intent string"
HIT = "question_id long, rank int, node_id string, name string, canonical string, definition string, quote string, book string, chapter string, locator string, aliases array<string>"
TERM, CITE = "question_id long, rank int, term string", "question_id long, rank int, mark string, coverage double"
PATH = "question_id long, rank int, steps array<struct<source string, relation string, target string>>, reason string"
DECISION = "question_id long, rank int, action string, names array<string>, reason string, content string, removed string"
CHUNK, CONCEPT = "question_id long, rank int, text string", "question_id long, concept string"


def hit(q, rank, name, book="生理学", chapter="第一章", definition="定义", quote=None, aliases=(), canonical=None):
    return (q, rank, f"n{rank}", name, canonical or name, definition, quote, book, chapter, f"第{rank}页", list(aliases))


def answered(spark, asked, terms=(), hits=(), paths=(), decisions=(), cites=(), chunks=(), concepts=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = R.answers(make(asked, ASKED), make(terms, TERM), make(hits, HIT), make(paths, PATH), make(decisions, DECISION), make(cites, CITE), make(chunks, CHUNK), make(concepts, CONCEPT))
    rows = out.collect()
    assert len(rows) == len({r.question_id for r in rows})
    return {r.question_id: (r.kind, r.answer) for r in rows}


def test_each_form(spark):
    hits = [h for q in (1, 2, 3, 7) for h in (hit(q, 2, "血压", "病理学", None, None, "引文。 "), hit(q, 1, "心输出量", definition="每分  钟\n射血量"), hit(q, 3, "血压", quote="无", definition=None))]
    step = lambda a, r, b: {"source": a, "relation": r, "target": b}
    paths = [(q, 2, [], "空") for q in (4, 5)] + [(q, 1, [step("甲", "PREREQUISITE_OF", "乙"), step("乙", "EXPLAINS", "丙")], None if q == 5 else "路径") for q in (4, 5, 7)]
    decisions = [(6, 1, "merge", ["乙", "甲", None, "丁", "丙", "戊"], "重复", "保留 的", ""), (6, 2, "remove", [], None, None, "旧"), (7, 1, "keep", ["甲"], "独立", None, None)]
    cites = [(q, 1, "[书, 章, 页]", 1.0) for q in (1, 4, 6, 7)]
    asked = [(i, "?", k) for i, k in enumerate(("definition", "coverage", "comparison", "prerequisite", "relation_path", "decision_review", "hybrid", "definition", "hybrid"), 1)]
    got = answered(spark, asked, [(2, 2, "血压"), (2, 1, "心输出量")], hits, paths, decisions, cites, [(9, 1, "  一段 原文")], [(3, "循环")])
    mark = {1: "[生理学, 第一章, 第1页]", 2: "[病理学, 未分章, 第2页]", 3: "[生理学, 第一章, 第3页]"}
    assert got[1] == ("definition", f"心输出量：每分 钟 射血量 {mark[1]}\n血压：引文。 {mark[2]}\n血压：无 {mark[3]}\n可展开原文证据：[书, 章, 页]")
    assert got[2] == ("coverage", f"心输出量、血压 在以下教材/章节中出现：\n- 生理学：第一章（心输出量）；第一章（血压） {mark[1]}\n- 病理学：第2页（血压） {mark[2]}")
    assert got[3] == ("comparison", f"不同教材说法对比如下：\n- 生理学：心输出量，每分 钟 射血量 {mark[1]}\n- 病理学：血压，引文。 {mark[2]}\n整合视图将其归入：循环，但保留各来源证据。")
    steps = "- 甲 --PREREQUISITE_OF--> 乙 -> 乙 --EXPLAINS--> 丙；依据："
    assert got[4] == ("prerequisite", f"前置知识路径：\n{steps}路径\n原文证据：[书, 章, 页]")
    assert got[5] == ("relation_path", f"关系路径：\n{steps}")
    names = "、".join(sorted(["乙", "甲", "丁", "丙", "戊"])[:4])
    assert got[6] == ("decision_review", f"相关整合决策如下：\n- merge {names}：重复；保留：保留 的\n- remove 相关节点：；压缩/移出：旧\n决策证据可回到原文：[书, 章, 页]")
    assert got[7] == ("hybrid", f"命中的核心知识点是 心输出量：每分 钟 射血量 {mark[1]}\n相关路径：甲 --PREREQUISITE_OF--> 乙。\n相关整合决策：keep，原因是 独立\n引用：[书, 章, 页]")
    assert got[8] == ("refused", NO_ANSWER) and got[9] == ("refused", NO_ANSWER)


def test_comparison_prefers_what_is_asked(spark):
    hits = [hit(1, 1, "别的", "甲书"), hit(1, 2, "血压高", "甲书"), hit(1, 3, "血 压", "乙书"), hit(2, 1, "别的", "甲书"), hit(2, 2, "血压", "乙书")]
    got = answered(spark, [(1, "?", "comparison"), (2, "?", "comparison")], [(1, 1, "血压"), (2, 1, "血压")], hits)
    assert [line.split("，")[0] for line in got[1][1].split("\n")[1:]] == ["- 乙书：血 压", "- 甲书：血压高"]
    assert [line.split("，")[0] for line in got[2][1].split("\n")[1:]] == ["- 乙书：血压", "- 甲书：别的"]


def test_grounds(spark):
    asked = [(1, "随便", "hybrid"), (2, "随便", "hybrid"), (3, "甲为什么导致乙", "relation_path"), (4, "甲为什么导致乙", "relation_path"), (5, None, "definition"), (6, "为什么", "definition"), (7, "x", None)]
    cites = [(1, 1, "m", 0.44), (2, 1, "m", 0.2), (2, 2, "m", 0.45), (3, 1, "m", 1.0), (4, 1, "m", 1.0), (6, 1, "m", None)]
    hits = [hit(1, 1, "甲"), hit(3, 1, "甲", aliases=["甲"]), hit(3, 2, "甲2", canonical="甲", aliases=["甲"]), hit(4, 1, "甲", aliases=["甲"]), hit(4, 2, "乙", aliases=["乙"]), hit(5, 1, "丙", aliases=["丙"])]
    flags = R.grounded(spark.createDataFrame(asked, ASKED), spark.createDataFrame(hits, HIT), spark.createDataFrame(cites, CITE))
    got = {r.question_id: (r.cited, r.hit) for r in flags.collect()}
    assert got == {1: (False, False), 2: (True, True), 3: (False, False), 4: (True, True), 5: (False, True), 6: (True, True), 7: (False, False)}
    assert {r.question_id for r in R.kept(spark.createDataFrame(hits, HIT), flags, "hit").collect()} == {4, 5}


def test_empty_and_long(spark):
    assert answered(spark, []) == {}
    kind, text = answered(spark, [(1, "?", "definition")], hits=[hit(1, 1, "甲", definition="长" * 100_000)])[1]
    assert kind == "definition" and text == "甲：" + "长" * 179 + "… [生理学, 第一章, 第1页]"
