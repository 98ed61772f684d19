"""Helpers shared by the corpus operators: the shared scratch folder and word handling."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Characters that part words where a contract says [^\x20\x09-\x0D]+.
BLANKS = "\t\n\x0b\x0c\r "


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is set on a local master (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Tables of one job in the shared folder, by name. Writing a name anew deletes its last table.

    A written table cuts lineage: lost executors lose nothing of it, and what follows does not compute
    it again. Two jobs never share a folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.dir, self.at = spark, f"{scratch_dir(spark)}/job-{uuid.uuid4().hex}", {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.dir}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.drop(name)
        self.at[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes these tables by Hadoop's file systems; what reads them must be done."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            if name in self.at:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at.pop(name))
                path.getFileSystem(conf).delete(path, True)

    def drop_all(self, but: tuple[str, ...] = ()) -> None:
        self.drop(*[n for n in self.at if n not in but])


def materialize(df: DataFrame) -> DataFrame:
    """df as a table of its own in the shared folder, for results that stay."""
    return Scratch(df.sparkSession).put("table", df)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def word_array(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; null text gives an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def has_word(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS)) != ""


def count_chars(text: Column, chars: str) -> Column:
    """How often any of these characters occurs in a text."""
    left = text
    for c in chars:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(left)).cast("long")
