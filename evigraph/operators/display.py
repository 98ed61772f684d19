"""The part of a graph that is shown: seeds, their best neighbours, and edges under degree caps.

Choices are greedy and each depends on those before, but a shown graph has at most n nodes. So what a choice can
depend on is bounded first, by Spark: the 2n best nodes, the n + 1 best neighbours of a chosen
node (one of which is not chosen yet), and the few best parallel edges of a pair that its caps can let
in. The choices are then made on these rows, graph by graph, and equal a walk over the whole graph.

nodes: graph, node_id, name, base (its own score); edges: graph, seq, source, target, score, contextual, with seq
different in a graph. Ties go to the smaller name and id of a node and the smaller seq of an edge.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Tables

#: Degree at which both ends are full, contextual edges of an end, and score from which a contextual edge continues a chain.
FULL, CHAIN, CHAIN_SCORE = 9, 2, 0.45
SEEDS, LEAST_SEEDS = 0.58, 24


def edge_budget(n: int) -> int:
    return max(60, int(n * 2.35))


def node_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with score: the base and the scores of all edges at a node."""
    ends = edges.select("graph", F.explode(F.array("source", "target")).alias("node_id"), "score")
    gain = ends.groupBy("graph", "node_id").agg(F.sum(F.col("score").cast("decimal(28,10)")).alias("gain"))
    # sums of decimals do not depend on the order of rows, so ranks do not either
    return nodes.join(gain, ["graph", "node_id"], "left").select("graph", "node_id", "name", F.round(F.col("base") + F.coalesce(F.col("gain").cast("double"), F.lit(0.0)), 6).alias("score"))


def neighbours(edges: DataFrame, of: DataFrame, n: int) -> DataFrame:
    """graph, node_id, other, place of the n + 1 best different neighbours of each node of `of`."""
    ends = [edges.select("graph", F.col(a).alias("node_id"), F.col(b).alias("other"), (-F.col("score")).alias("low"), "seq") for a, b in (("source", "target"), ("target", "source"))]
    near = ends[0].unionByName(ends[1]).where("node_id <> other").join(of, ["graph", "node_id"], "left_semi")
    best = near.groupBy("graph", "node_id", "other").agg(F.min(F.struct("low", "seq")).alias("best"))
    place = F.row_number().over(Window.partitionBy("graph", "node_id").orderBy("best", "other"))
    return best.withColumn("place", place).where(F.col("place") <= n + 1).drop("best")


def grow(ranked: list, near: dict, n: int) -> tuple[list, bool]:
    """The chosen nodes in order of choice, and whether the choice is complete: it stops at a node whose neighbours are not known."""
    chosen = list(ranked[: min(n, max(LEAST_SEEDS, int(n * SEEDS)))])
    held = set(chosen)
    while len(chosen) < n:
        before = len(chosen)
        for node in list(chosen):
            if node not in near:
                return chosen, False
            other = next((x for x in near[node] if x not in held), None)
            if other is not None:
                chosen.append(other)
                held.add(other)
            if len(chosen) >= n:
                break
        if len(chosen) == before:
            other = next((x for x in ranked if x not in held), None)
            if other is None:
                break
            chosen.append(other)
            held.add(other)
    return chosen, True


def chosen_nodes(scored: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """graph, node_id of at most n nodes of each graph."""
    tables = Tables(scored.sparkSession)
    kind = scored.schema["node_id"].dataType.simpleString()
    graph = scored.schema["graph"].dataType.simpleString()
    order = Window.partitionBy("graph").orderBy(F.desc("score"), "name", "node_id")
    ranked = tables.write("ranked", scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * n).select("graph", "node_id", "rank"))
    wanted, near, done = ranked.where(F.col("rank") <= n).select("graph", "node_id"), None, False

    def choose(key: tuple, own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        by_node = {node: [] for node in known["node_id"]}
        met = known.dropna(subset=["other"]).sort_values(["node_id", "place"])
        for node, other in zip(met["node_id"], met["other"].astype(own["node_id"].dtype), strict=True):
            by_node[node].append(other)
        picked, complete = grow(list(own.sort_values("rank")["node_id"]), by_node, n)
        return pd.DataFrame({"graph": key[0], "node_id": picked, "complete": complete, "known": [x in by_node for x in picked]})

    while not done:
        fresh = wanted.join(neighbours(edges, wanted, n), ["graph", "node_id"], "left").select("graph", "node_id", "other", "place")
        near = tables.write("near", fresh if near is None else near.unionByName(fresh))
        out = ranked.groupBy("graph").cogroup(near.groupBy("graph")).applyInPandas(choose, f"graph {graph}, node_id {kind}, complete boolean, known boolean")
        out = tables.write("chosen", out)
        wanted = out.where("not complete and not known").select("graph", "node_id")
        done = wanted.isEmpty()
    tables.drop("ranked", "near")
    return out.select("graph", "node_id")


def pick_edges(rows: list[tuple], budget: int) -> list:
    """seq of the edges taken from (seq, source, target, score, contextual), each list in order of falling score."""
    degree: dict = {}
    context: dict = {}
    taken = []
    for last in (False, True):
        for seq, a, b, score, contextual in rows:
            if contextual != last:
                continue
            if len(taken) >= budget:
                return taken
            da, db = degree.get(a, 0), degree.get(b, 0)
            if last:
                chain = context.get(a, 0) < CHAIN and context.get(b, 0) < CHAIN and score >= CHAIN_SCORE
                fits = da == 0 or db == 0 or chain
            else:
                fits = da < FULL or db < FULL
            if fits:
                taken.append(seq)
                for x in (a, b):
                    degree[x] = degree.get(x, 0) + 1
                    context[x] = context.get(x, 0) + last
    return taken


def chosen_edges(edges: DataFrame, kept: DataFrame, budget: int) -> DataFrame:
    """graph, seq, source, target, score, place of the edges shown between kept nodes."""
    for end in ("source", "target"):
        edges = edges.join(kept.select("graph", F.col("node_id").alias(end)), ["graph", end], "left_semi")
    # of parallel edges no more than FULL (or CHAIN + 1) can be taken before both ends are full
    pair = Window.partitionBy("graph", "contextual", F.least("source", "target"), F.greatest("source", "target")).orderBy(F.desc("score"), "seq")
    few = edges.withColumn("n", F.row_number().over(pair)).where(F.col("n") <= F.when(F.col("contextual"), CHAIN + 1).otherwise(FULL))
    columns = ["graph", "seq", "source", "target", "score", "contextual"]

    def take(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["score", "seq"], ascending=[False, True])
        taken = pick_edges(list(df[columns[1:]].itertuples(index=False, name=None)), budget)
        out = df.set_index("seq", drop=False).loc[taken].reset_index(drop=True)
        return out.assign(place=range(1, len(out) + 1))

    few = few.select(columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in few.schema)
    return few.groupBy("graph").applyInPandas(take, schema + ", place int")


def display(nodes: DataFrame, edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) shown of each graph, nodes with score and rank. A graph within both limits is shown whole; else
    nodes without a shown edge are kept only up to a tenth of n, at least 6 and at most 18."""
    tables = Tables(nodes.sparkSession)
    budget = edge_budget(n)
    scored = tables.write("scored", node_scores(nodes, edges))
    edge_counts = edges.groupBy("graph").agg(F.count("*").alias("edges"))
    large = scored.groupBy("graph").agg(F.count("*").alias("nodes")).join(edge_counts, "graph", "left")
    large = tables.write("large", large.where((F.col("nodes") > n) | (F.col("edges") > budget)).select("graph"))
    of = lambda df: df.join(large, "graph", "left_semi")
    kept = tables.write("kept", chosen_nodes(of(scored), of(edges), n))
    shown = tables.write("shown", chosen_edges(of(edges), kept, budget))
    ends = shown.select("graph", F.explode(F.array("source", "target")).alias("node_id")).distinct().withColumn("linked", F.lit(True))
    own = scored.join(kept, ["graph", "node_id"], "left_semi").join(ends, ["graph", "node_id"], "left")
    lone = Window.partitionBy("graph", "linked").orderBy(F.desc("score"), "name", "node_id")
    own = own.withColumn("r", F.row_number().over(lone)).where(F.col("linked") | (F.col("r") <= max(6, min(18, n // 10)))).select("graph", "node_id", "name", "score")
    rest = scored.join(large, "graph", "left_anti")
    by = Window.partitionBy("graph").orderBy(F.desc("score"), "name", "node_id")
    out = own.unionByName(rest).withColumn("rank", F.row_number().over(by))
    whole = edges.join(large, "graph", "left_anti").select("graph", "seq", "source", "target", "score", "contextual")
    whole = whole.withColumn("place", F.row_number().over(Window.partitionBy("graph").orderBy("seq")))
    return out, shown.unionByName(whole)
