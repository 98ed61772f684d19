"""Connected components of an undirected graph by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Tables


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the smallest id of the class) of every node with an edge.

    Each round every node moves to the neighbour, or itself, that a fresh random order puts first;
    renamed edges shrink by a constant factor a round for any shape of graph.
    """
    tables = Tables(edges.sparkSession)
    live = tables.write("live", edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    names = tables.write("names", edges.select(F.explode(F.array(a, b)).alias("id")).distinct().withColumn("at", F.col("id")))
    turn = 0
    while not live.isEmpty():
        turn += 1
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.xxhash64(F.lit(turn), c)  # noqa: E731,B023
        move = both.groupBy("a").agg(F.min_by("b", rank(F.col("b"))).alias("to"), F.min(rank(F.col("b"))).alias("r"))
        move = tables.write("move", move.where(F.col("r") < rank(F.col("a"))).select("a", "to"))
        ends = live.join(move.select("a", F.col("to").alias("ta")), "a", "left").join(move.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b", "left")
        ends = ends.select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y")).where("x <> y")
        live = tables.write("live", ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        names = tables.write("names", names.join(move.withColumnRenamed("a", "at"), "at", "left").select("id", F.coalesce("to", "at").alias("at")))
    tables.drop("live", "move")
    return names.join(names.groupBy("at").agg(F.min("id").alias("component")), "at").select("id", "component")
