"""Edits as a stream: new files of an append-only edit log are read once and folded into the decisions.

An extension: the work it stands for is a batch that reads the log again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "decision_id string, seq long, at timestamp, action string, confidence double, content string"


def edit_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)


def latest_edits(edits: DataFrame, delay: str = "1 day") -> DataFrame:
    """decision_id and its latest edit; repeats of an edit (in a stream, within the delay) count once."""
    if edits.isStreaming:
        once = edits.withWatermark("at", delay).dropDuplicatesWithinWatermark(["decision_id", "seq"])
    else:
        once = edits.dropDuplicates(["decision_id", "seq"])
    return once.groupBy("decision_id").agg(F.max_by(F.struct("action", "confidence", "content"), "seq").alias("edit"), F.count("*").alias("n_edits"))


def append_log(edits: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new to a Parquet log, and ends when there is no more."""
    return edits.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
