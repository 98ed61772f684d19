"""Replies to questions: what is grounded, and the text of an answer by the intent of its question.

asked: question_id, question, intent. hits: question_id, rank, node_id, name, canonical, definition, quote, book, chapter, locator,
aliases (of which the question names). terms: question_id, rank, term. paths: question_id, rank, steps (array of source, relation,
target, as names), reason. decisions: question_id, rank, action, names (array), reason, content, removed. citations: question_id,
rank, mark, coverage. chunks: question_id, rank, text.

Each of these holds a few rows a question, as the steps before have cut them, so a question's rows are one array each and an answer
is made by array functions, without windows over all. Ranks are distinct in a question; of equal ones the order is by the rows'
values. Null texts are empty; a question without any of these gets the refusal. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ask import HYBRID_COVERAGE, NO_ANSWER


@dataclass(frozen=True)
class Phrases:
    """What answers are made of."""

    no_chapter: str = "未分章"
    definition_cites: str = "可展开原文证据："
    coverage: str = "%s 在以下教材/章节中出现："
    comparison: str = "不同教材说法对比如下："
    concept: str = "整合视图将其归入：%s，但保留各来源证据。"
    prerequisite: str = "前置知识路径："
    relation_path: str = "关系路径："
    grounds: str = "；依据："
    path_cites: str = "原文证据："
    decisions: str = "相关整合决策如下："
    some_nodes: str = "相关节点"
    retained: str = "；保留："
    removed: str = "；压缩/移出："
    decision_cites: str = "决策证据可回到原文："
    core: str = "命中的核心知识点是 %s：%s %s"
    path: str = "相关路径：%s。"
    decision: str = "相关整合决策：%s，原因是 %s"
    cites: str = "引用："


# The phrases of answers, and the words of questions on causes.
ZH = Phrases()
CAUSES = ("影响", "导致", "引起", "造成", "为什么", "如何")
#: Rows and characters that an answer takes up, as fixed values.
TOP_DEFINED, TOP_LISTED, TOP_COMPARED, TOP_PATHS, TOP_DECISIONS, TOP_NAMES, TOP_TERMS = 3, 4, 6, 3, 5, 4, 3
DEFINED, COMPARED, DECIDED = 180, 160, 100


def grounded(asked: DataFrame, hits: DataFrame, citations: DataFrame, causes: tuple[str, ...] = CAUSES) -> DataFrame:
    """question_id, cited, hit: whether its citations, and its hits and terms, may stand.

    Citations of an open question that cover less than `HYBRID_COVERAGE` of it go. A question on causes that names fewer than
    two concepts keeps neither. Without citations, hits stand only if the question names one of them.
    """
    best = citations.groupBy("question_id").agg(F.max(F.coalesce("coverage", F.lit(0.0))).alias("_best"))
    named = hits.where(F.size("aliases") > 0).groupBy("question_id").agg(F.count_distinct(F.coalesce("canonical", "name")).alias("_named"))
    rows = asked.join(best, "question_id", "left").join(named, "question_id", "left")
    named_n = F.coalesce("_named", F.lit(0))
    vague = F.col("intent").isin("hybrid", "relation_path") & T.contains_any(F.coalesce("question", F.lit("")), causes) & (named_n < 2)
    vague = F.coalesce(vague, F.lit(False))
    thin = F.coalesce((F.col("intent") == "hybrid") & (F.col("_best") < HYBRID_COVERAGE), F.lit(False))
    cited = F.col("_best").isNotNull() & ~thin & ~vague
    return rows.select("question_id", cited.alias("cited"), (~vague & (cited | (named_n > 0))).alias("hit"))


def kept(rows: DataFrame, flags: DataFrame, flag: str) -> DataFrame:
    """The rows of questions with this flag of `grounded`."""
    return rows.join(flags.where(flag).select("question_id"), "question_id", "left_semi")


def first_concepts(hits: DataFrame, members: DataFrame) -> DataFrame:
    """question_id, concept: the first concept that holds a hit. members: seq, concept, node_id."""
    met = hits.select("question_id", "node_id").join(members, "node_id")
    return met.groupBy("question_id").agg(F.min(F.struct("seq", "concept"))["concept"].alias("concept"))


def _listed(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias(name))


def _text(value: Column, n: int) -> Column:
    return T.truncate(T.collapse(value), n)


def _lines(*parts: Column) -> Column:
    """Arrays of lines, one after the other, as one text."""
    return F.array_join(F.concat(*parts), "\n")


def _line(text: Column) -> Column:
    """One line, or none where it is null."""
    return F.array_compact(F.array(text))


def answers(
    asked: DataFrame, terms: DataFrame, hits: DataFrame, paths: DataFrame, decisions: DataFrame, citations: DataFrame, chunks: DataFrame, concepts: DataFrame, say: Phrases = ZH
) -> DataFrame:
    """question_id, intent, kind (the form that the answer has, or refused), answer. concepts: question_id, concept."""
    empty = lambda c: F.nullif(c, F.lit(""))
    told = hits.select(
        "question_id", "rank", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("canonical", "name").alias("canonical"), F.coalesce("book", F.lit("")).alias("book"),
        F.coalesce(empty(F.col("definition")), empty(F.col("quote")), "name").alias("says"), F.coalesce(empty(F.col("definition")), "name").alias("core"),
        F.coalesce(empty(F.col("chapter")), F.col("locator")).alias("place"),
        F.concat(F.lit("["), F.coalesce("book", F.lit("")), F.lit(", "), F.coalesce(empty(F.col("chapter")), F.lit(say.no_chapter)), F.lit(", "), F.coalesce("locator", F.lit("")), F.lit("]")).alias("mark"),
    )
    rows = asked.select("question_id", "intent")
    for part in (
        _listed(told, "h", [c for c in told.columns if c not in ("question_id", "rank")]), _listed(terms, "t", ["term"]), _listed(paths, "p", ["steps", "reason"]),
        _listed(decisions, "d", ["action", "names", "reason", "content", "removed"]), _listed(citations, "c", ["mark"]), _listed(chunks, "x", ["text"]), concepts,
    ):
        rows = rows.join(part, "question_id", "left")
    h, p, d, none = F.col("h"), F.col("p"), F.col("d"), F.lit(None).cast("string")
    mark, books = F.get(F.col("c"), F.lit(0))["mark"], F.array_sort(F.array_distinct(F.transform("h", lambda x: x["book"])))
    of = lambda items, book: F.filter(items, lambda x: x["book"] == book)
    first = lambda items: F.get(items, F.lit(0))
    step = lambda s: F.concat(s["source"], F.lit(" --"), s["relation"], F.lit("--> "), s["target"])
    cites = lambda phrase: _line(F.concat(F.lit(phrase), mark))

    defined = F.transform(F.slice(h, 1, TOP_DEFINED), lambda x: F.concat(x["name"], F.lit("："), _text(x["says"], DEFINED), F.lit(" "), x["mark"]))
    definition = _lines(defined, cites(say.definition_cites))

    about = F.when(F.size("t") > 0, F.array_join(F.transform(F.slice("t", 1, TOP_TERMS), lambda x: x["term"]), "、")).otherwise(first(h)["name"])
    places = lambda own: F.array_join(F.transform(F.slice(own, 1, TOP_LISTED), lambda x: F.concat(x["place"], F.lit("（"), x["name"], F.lit("）"))), "；")
    covered = F.transform(books, lambda b: F.concat(F.lit("- "), b, F.lit("："), places(of(h, b)), F.lit(" "), first(of(h, b))["mark"]))
    coverage = _lines(F.array(F.format_string(say.coverage, about)), covered)

    norms = F.transform("t", lambda x: T.normalize_term(x["term"]))
    named = lambda x: F.array_contains(F.transform("t", lambda y: y["term"]), x["canonical"]) | F.exists(norms, lambda n: F.contains(T.normalize_term(x["canonical"]), n))
    meant = F.when(F.size("t") > 0, F.filter(h, named)).otherwise(h)
    meant = F.when(F.size(F.array_distinct(F.transform(meant, lambda x: x["book"]))) >= 2, meant).otherwise(F.slice(h, 1, TOP_COMPARED))
    compare = lambda b, x: F.concat(F.lit("- "), b, F.lit("："), x["name"], F.lit("，"), _text(x["says"], COMPARED), F.lit(" "), x["mark"])
    rows = rows.withColumn("_meant", meant)
    own_books = F.array_sort(F.array_distinct(F.transform("_meant", lambda x: x["book"])))
    compared = F.transform(own_books, lambda b: compare(b, first(of(F.col("_meant"), b))))
    comparison = _lines(F.array(F.lit(say.comparison)), compared, _line(F.when(F.col("concept").isNotNull(), F.format_string(say.concept, "concept"))))

    walked = F.filter(F.slice(p, 1, TOP_PATHS), lambda x: F.size(x["steps"]) > 0)
    walked = F.transform(walked, lambda x: F.concat(F.lit("- "), F.array_join(F.transform(x["steps"], step), " -> "), F.lit(say.grounds), F.coalesce(x["reason"], F.lit(""))))
    along = lambda title: _lines(F.array(F.lit(title)), walked, cites(say.path_cites))

    more = lambda phrase, value: F.when(F.length(value) > 0, F.concat(F.lit(phrase), _text(value, DECIDED))).otherwise(F.lit(""))
    names = lambda x: F.coalesce(F.nullif(F.array_join(F.slice(F.array_sort(F.array_distinct(F.array_compact(x["names"]))), 1, TOP_NAMES), "、"), F.lit("")), F.lit(say.some_nodes))
    decided = F.transform(F.slice(d, 1, TOP_DECISIONS), lambda x: F.concat(F.lit("- "), x["action"], F.lit(" "), names(x), F.lit("："), F.coalesce(x["reason"], F.lit("")), more(say.retained, x["content"]), more(say.removed, x["removed"])))
    decision = _lines(F.array(F.lit(say.decisions)), decided, cites(say.decision_cites))

    top = first(h)
    core = F.when(top.isNotNull(), F.format_string(say.core, top["name"], _text(top["core"], COMPARED), top["mark"]))
    way = first(first(p)["steps"])
    chunk = first(F.col("x"))["text"]
    hybrid = _lines(
        _line(core), _line(F.when(way.isNotNull(), F.format_string(say.path, step(way)))), _line(F.when(first(d).isNotNull(), F.format_string(say.decision, first(d)["action"], F.coalesce(first(d)["reason"], F.lit(""))))),
        _line(F.when(mark.isNotNull(), F.concat(F.lit(say.cites), mark)).when(chunk.isNotNull(), _text(chunk, DEFINED)).otherwise(none)),
    )

    has = {"h": F.coalesce(F.size("h"), F.lit(0)) > 0, "p": F.coalesce(F.size("p"), F.lit(0)) > 0, "d": F.coalesce(F.size("d"), F.lit(0)) > 0}
    nothing = ~(has["h"] | has["p"] | has["d"] | (F.coalesce(F.size("c"), F.lit(0)) > 0))
    forms = [("decision_review", "d", decision), ("coverage", "h", coverage), ("comparison", "h", comparison), ("prerequisite", "p", along(say.prerequisite)), ("relation_path", "p", along(say.relation_path)), ("definition", "h", definition)]
    kind, answer = F.lit("hybrid"), hybrid
    for name, needs, form in reversed(forms):
        fits = (F.col("intent") == name) & has[needs]
        kind, answer = F.when(fits, name).otherwise(kind), F.when(fits, form).otherwise(answer)
    out = rows.select("question_id", "intent", F.when(nothing, "refused").otherwise(kind).alias("kind"), F.when(nothing, F.lit(NO_ANSWER)).otherwise(answer).alias("answer"))
    return out.withColumn("answer", F.coalesce(F.nullif(F.col("answer"), F.lit("")), F.lit(NO_ANSWER)))
