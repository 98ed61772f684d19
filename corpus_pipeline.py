"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, source mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the
columns of documents, but for the last, which returns the packed pieces. Between stages the rows are
written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evigraph.llm import stages
from evigraph.llm.common import Scratch

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("line_dedup", stages.line_dedup),
    ("ngram_jaccard", stages.ngram_jaccard),
    ("mix_sources", stages.mix_sources),
    ("best_fit_packing", stages.best_fit_packing),
]

#: The risk-controlled cutoffs, edit classes and packing are not expressible in SQL; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for _, stage in STAGES:
        # the table of the stage before goes once this one's is written
        docs = scratch.put("docs", stage(spark, docs, sf_dir))
    return docs
