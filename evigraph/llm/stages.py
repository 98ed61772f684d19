"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> documents that go on.

Each stage carries documents whole, so that no column of theirs can clash with one of its own. Nulls,
empty and long texts, ties and repeated rows are treated as the operator that it calls says; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linededup, mixing, ngramjoin, packing, quality
from .queries import table, tokenizer_path


def _whole(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id and the given columns, with each row whole as _doc, so that no column of it can clash."""
    return docs.select("doc_id", *columns, F.struct(*docs.columns).alias("_doc"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the calibrated cutoffs reject."""
    judged = quality.judge(_whole(docs, "lang", "text"), table(spark, sf_dir, "labels"), carry=("_doc",))
    return judged.where("kept").select("_doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeated lines; a document that loses all its lines goes."""
    return linededup.dedup(docs).select(docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return ngramjoin.keep_one(docs).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the mix takes them: whole copies, and the first words of one in part."""
    return mixing.repeat(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the packed sequences."""
    return packing.pack(packing.pieces(docs, tokenizer_path()))
