"""Graph questions: intent, recognised concepts, node hits, decisions, evidence and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import Lexicon

MIN_NODE_SCORE = 1.2
HYBRID_COVERAGE = 0.45
# The answer to a question without grounds.
NO_ANSWER = "当前知识库中未找到相关信息。"
SOURCE_FACTOR = {"rag": 1.0, "node": 0.92, "path": 0.88, "decision": 0.86}


def intent(question: Column, pack: Lexicon) -> Column:
    return T.first_marker(question, pack.intents, "hybrid")


def action_of(text: Column, pack: Lexicon) -> Column:
    """The action of the first listed word that the text has; null if none."""
    return T.first_marker(F.lower(text), pack.actions, None)


def node_hits(questions: DataFrame, nodes: DataFrame, k: int, qkey: str = "question_id", question: str = "question") -> DataFrame:
    """qkey, node_id, score (over the best), rank of the nodes that a question names or shares words with.

    nodes: node_id, name, definition. Shared tokens are an equi-join; a name that stands in the question
    is found by the token that it begins with, so no question is compared with every node.
    """
    qt = questions.select(qkey, question, F.explode(F.array_distinct(T.tokens(F.col(question)))).alias("term"))
    nt = nodes.select("node_id", "name", F.explode(F.array_distinct(T.tokens(F.concat_ws(" ", "name", "definition")))).alias("term"))
    shared = qt.join(nt, "term").groupBy(qkey, "node_id").agg(F.count("*").alias("overlap"), F.first(question).alias("q"), F.first("name").alias("name"))
    named = F.contains(F.lower("q"), F.lower("name"))
    score = F.col("overlap") * 0.45 + F.when(named, 3.5).otherwise(0.0) + F.when(F.contains("q", F.col("name")), 2.0).otherwise(0.0)
    hits = shared.withColumn("raw", score).where(F.col("raw") >= MIN_NODE_SCORE)
    own = Window.partitionBy(qkey)
    ranked = hits.withColumn("rank", F.row_number().over(own.orderBy(F.desc("raw"), "name", "node_id"))).where(F.col("rank") <= 3 * k)
    return ranked.select(qkey, "node_id", F.round(F.least(F.lit(1.0), F.col("raw") / F.max("raw").over(own)), 4).alias("score"), "rank")


def rerank(evidence: DataFrame, k: int, qkey: str = "question_id", key: str = "chunk_id") -> DataFrame:
    """One row for each question and chunk, from the first source that has it, the k most relevant.

    evidence: qkey, key, source, seq, relevance.
    """
    order = F.lit(len(SOURCE_FACTOR))
    factor = F.lit(1.0)
    for i, (name, f) in enumerate(SOURCE_FACTOR.items()):
        order = F.when(F.col("source") == name, i).otherwise(order)
        factor = F.when(F.col("source") == name, f).otherwise(factor)
    rows = evidence.withColumn("source_rank", order).withColumn("relevance", F.round(F.col("relevance") * factor, 4))
    once = rows.withColumn("r", F.row_number().over(Window.partitionBy(qkey, key).orderBy("source_rank", "seq", F.desc("relevance")))).where("r = 1")
    best = Window.partitionBy(qkey).orderBy(F.desc("relevance"), "source_rank", "seq", key)
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(k, 1)).select(qkey, key, "source", "relevance", "rank")


def neighbour_paths(edges: DataFrame, per_node: int = 3) -> DataFrame:
    """The best edges of each node in either direction: node, other, relation, confidence, rank."""
    ends = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "relation", "confidence").unionByName(
        edges.select(F.col("target").alias("node"), F.col("source").alias("other"), "relation", "confidence")
    )
    r = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("confidence"), "relation", "other"))
    return ends.withColumn("rank", r).where(F.col("rank") <= per_node)


def answers(questions: DataFrame, citations: DataFrame, qkey: str = "question_id") -> DataFrame:
    """qkey, answer: the quotes in order with their sources, or the refusal. citations: qkey, rank, quote, mark."""
    part = F.concat("quote", F.lit(" ["), "mark", F.lit("]"))
    said = citations.groupBy(qkey).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), "\n").alias("answer"))
    return questions.select(qkey).join(said, qkey, "left").select(qkey, F.coalesce("answer", F.lit(NO_ANSWER)).alias("answer"))
