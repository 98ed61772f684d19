"""Files sent in parts: rules on parts, progress, and assembled files by digest.

sessions: session_id, total_bytes, total_parts, part_bytes, sha256 (expected, or null); parts: session_id, part_no (from 0), seq (a
number that orders the writes), content (binary). A part that is written again replaces the one before. Contents of a file are
never put into one row: its digest is taken over the sorted rows as they stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged_parts(sessions: DataFrame, parts: DataFrame) -> DataFrame:
    """parts of known sessions with error: index, empty, too_large, size, or null for a part that is taken."""
    n = F.coalesce(F.octet_length("content"), F.lit(0))
    rows = parts.join(sessions.select("session_id", "total_parts", "part_bytes"), "session_id")
    error = (
        F.when((F.col("part_no") < 0) | (F.col("part_no") >= F.col("total_parts")), "index").when(n == 0, "empty").when(n > F.col("part_bytes"), "too_large")
        .when((F.col("part_no") < F.col("total_parts") - 1) & (n != F.col("part_bytes")), "size")
    )
    return rows.withColumn("error", error).drop("total_parts", "part_bytes")


def taken_parts(judged: DataFrame) -> DataFrame:
    """session_id, part_no, content: the last part taken of each number."""
    last = judged.where("error is null").groupBy("session_id", "part_no").agg(F.max_by("content", "seq").alias("content"))
    return last.withColumn("bytes", F.octet_length("content").cast("long"))


def progress(sessions: DataFrame, taken: DataFrame) -> DataFrame:
    """session_id, n_parts, n_missing, received, progress (percent, 100 only for what is whole or over it)."""
    got = taken.groupBy("session_id").agg(F.count("*").alias("n_parts"), F.sum("bytes").alias("received"))
    out = sessions.join(got, "session_id", "left").withColumns({"n_parts": F.coalesce("n_parts", F.lit(0)), "received": F.coalesce("received", F.lit(0))})
    share = F.when(F.col("total_bytes") > 0, F.least(F.lit(100), F.floor(F.col("received") / F.col("total_bytes") * 100))).otherwise(0)
    return out.withColumn("n_missing", F.col("total_parts") - F.col("n_parts")).withColumn("progress", share.cast("int"))


def digests(taken: DataFrame) -> DataFrame:
    """session_id, digest: the SHA-256 of each session's contents in order. A hash is sequential, so a session is one
    task's stream; only the state of the hash is held."""
    kind = taken.schema["session_id"].dataType.simpleString()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, type_ = None, None, None
        for batch in batches:
            type_ = batch.column("session_id").type
            ids, sums = [], []
            for s, content in zip(batch.column("session_id").to_pylist(), batch.column("content"), strict=True):
                if state is None or s != at:
                    if state is not None:
                        ids.append(at)
                        sums.append(state.hexdigest())
                    at, state = s, hashlib.sha256()
                state.update(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(ids, type_), pa.array(sums, pa.string())], ["session_id", "digest"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], type_), pa.array([state.hexdigest()])], ["session_id", "digest"])

    rows = taken.select("session_id", "part_no", F.col("content").cast("binary").alias("content"))
    return rows.repartition("session_id").sortWithinPartitions("session_id", "part_no").mapInArrow(stream, f"session_id {kind}, digest string")


def assemble(sessions: DataFrame, parts: DataFrame) -> DataFrame:
    """session_id, n_parts, n_missing, received, progress, status (missing, size_mismatch, sha256_mismatch, assembled), digest and file_id of
    what is assembled."""
    taken = taken_parts(judged_parts(sessions, parts))
    state = progress(sessions, taken)
    whole = (F.col("n_missing") == 0) & (F.col("received") == F.col("total_bytes"))
    out = state.join(digests(taken.join(state.where(whole).select("session_id"), "session_id", "left_semi")), "session_id", "left")
    expected = F.coalesce(F.lower("sha256"), F.lit(""))
    status = (
        F.when(F.col("n_missing") > 0, "missing").when(F.col("received") != F.col("total_bytes"), "size_mismatch")
        .when((expected != "") & (expected != F.col("digest")), "sha256_mismatch").otherwise("assembled")
    )
    done = F.col("status") == "assembled"
    out = out.withColumn("status", status).withColumn("digest", F.when(done, F.col("digest"))).withColumn("file_id", F.when(done, F.concat(F.lit("upload_"), F.substring("digest", 1, 16))))
    return out.select("session_id", "n_parts", "n_missing", "received", "progress", "status", "digest", "file_id")
