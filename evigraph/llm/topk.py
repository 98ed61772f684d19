"""Exact top-k search: tiled integer matrix products, selection per tile, and a tree of merges.

Candidates are dealt by hash into shards of about `SHARD_ROWS`, queries into blocks of about
`BLOCK_ROWS`; every pair of a shard and a block is one tile. A tile multiplies its two matrices and
keeps each query's k best by (score, smaller id); the lists of `FAN` shards at a time are merged
until one list a query is left. Products are exact: in doubles while they stay below 2^53, in
64-bit integers below 2^63, and in Python integers beyond.

Nulls: rows with a null id, a null vector, or a null or non-finite component take no part. Vectors
of different lengths have no score. A candidate with the query's id is its own row and left out.
Query rows that repeat an id and vector count once; repeated candidate rows each count. Empty
tables give an empty result. Scores beyond 64 bits are ranked exactly and given as the limit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARD_ROWS, BLOCK_ROWS, FAN = 8192, 2048, 16
SCALE = 256


def quantize(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as double (a whole number); null where the vector can't take part."""
    xs = F.transform(vector, lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(~F.exists(xs, bad), F.transform(xs, lambda x: _floor(x * F.lit(float(scale)))))


def _floor(x: Column) -> Column:
    """floor that stays a double; doubles of 2^53 and more are whole already."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def _matrix(rows: pd.Series, dims: int) -> np.ndarray:
    return np.stack(rows.to_numpy()).reshape(len(rows), dims)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows."""
    limit = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if limit < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if limit < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    return exact(a) @ exact(b).T


def _best(q: pd.DataFrame, c: pd.DataFrame, k: int) -> list[tuple]:
    """(query id, id, score) of the k best of c for each row of q."""
    out = []
    q, c = q.assign(dims=q["v"].map(len)), c.assign(dims=c["v"].map(len))
    for dims, mine in q.groupby("dims"):
        cand = c[c["dims"] == dims].sort_values("id", kind="stable")
        if cand.empty:
            continue
        ids, qids = cand["id"].to_numpy(), mine["id"].to_numpy()
        scores = _scores(_matrix(mine["v"], dims), _matrix(cand["v"], dims))
        for row, own in zip(scores, qids):
            # own rows are skipped below; as ids are in order, their number is known
            skip = int(np.searchsorted(ids, own, "right") - np.searchsorted(ids, own, "left"))
            keep = min(len(row), k + skip)
            if row.dtype == object:
                order = sorted(range(len(row)), key=lambda i: (-row[i], i))[:keep]
            else:
                bar = np.partition(row, len(row) - keep)[len(row) - keep]
                over = np.flatnonzero(row > bar)
                ties = np.flatnonzero(row == bar)[: keep - len(over)]  # the smallest ids
                order = np.concatenate([over, ties])
                order = order[np.lexsort((order, -row[order]))]
            found = [(int(own), int(ids[i]), int(row[i])) for i in order if ids[i] != own][:k]
            out += found
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), the key and score of the k best candidates of each query."""
    ready = lambda df: df.select(F.col(key).cast("long").alias("id"), quantize(F.col(vector), scale).alias("v")).where("id is not null and v is not null")
    cands = materialize(ready(candidates))
    qs = materialize(ready(queries).distinct())
    shards = max(1, -(-cands.count() // SHARD_ROWS))
    blocks = max(1, -(-qs.count() // BLOCK_ROWS))
    part = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    # a tile gets a copy of its block and of its shard
    left = qs.withColumn("block", part(blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = cands.withColumn("shard", part(shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def tile(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "shard": [], "id": [], "score": []}).astype({"query_id": "int64", "shard": "int32", "id": "int64", "score": "object"})
        rows = _best(q, c, k)
        return pd.DataFrame(
            {"query_id": [r[0] for r in rows], "shard": np.int32(q["shard"].iloc[0]), "id": [r[1] for r in rows], "score": [str(r[2]) for r in rows]}
        )

    lists = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(tile, "query_id long, shard int, id long, score string")
    lists = lists.withColumn("score", F.col("score").cast("decimal(38,0)"))
    while True:
        merged = max(1, -(-shards // FAN))
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
        order = Window.partitionBy("query_id", "shard").orderBy(F.col("score").desc(), "id")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if merged == 1:
            break
        shards, lists = merged, lists.drop("rank")
    limit = lambda x: F.lit(x).cast("decimal(38,0)")
    score = F.least(F.greatest(F.col("score"), limit(-(1 << 63))), limit((1 << 63) - 1)).cast("long")
    return lists.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), score.alias("score"))
