"""File sources: text, Markdown, CSV/TSV and converted books as tables of documents and rows."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEXT = ("txt", "md", "markdown")
SHEET = ("csv", "tsv")
#: Formats that must be converted first.
LEGACY = ("doc", "xls", "ppt")


def decode(content: bytes) -> str:
    """UTF-8 with or without a mark, then GB18030, then UTF-8 with replacements."""
    for encoding in ("utf-8-sig", "gb18030"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            pass
    return content.decode("utf-8", errors="replace")


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """raw_file_id, path, filename, format, size, sha256, content of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    digest = F.sha2("content", 256)
    name = F.substring_index("path", "/", -1)
    return files.select(
        F.concat(F.lit("raw_"), F.substring(digest, 1, 16)).alias("raw_file_id"), "path", name.alias("filename"), F.lower(F.substring_index(name, ".", -1)).alias("format"),
        F.col("length").alias("size"), digest.alias("sha256"), "content",
    )


def rejects(files: DataFrame) -> DataFrame:
    """Files that are not read, with the reason."""
    reason = F.when(F.col("format").isin(*LEGACY), "convert to the current format first").otherwise("unknown format")
    return files.where(~F.col("format").isin(*TEXT, *SHEET)).select("raw_file_id", "filename", "format", reason.alias("reason"))


def text_documents(files: DataFrame) -> DataFrame:
    """raw_file_id, filename, text of the text and Markdown files."""

    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:
        return content.map(decode)

    return files.where(F.col("format").isin(*TEXT)).select("raw_file_id", "filename", decoded("content").alias("text"))


def sheet_rows(files: DataFrame) -> DataFrame:
    """raw_file_id, row_no (from 1), cells of the CSV and TSV files; the delimiter of a CSV is sniffed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                text = decode(r.content)
                rows = list(csv.reader(io.StringIO(text), delimiter="\t" if r.format == "tsv" else sniffed(text)))
                yield pd.DataFrame({"raw_file_id": r.raw_file_id, "row_no": range(1, len(rows) + 1), "cells": rows})

    sheets = files.where(F.col("format").isin(*SHEET)).select("raw_file_id", "format", "content")
    return sheets.mapInPandas(run, "raw_file_id string, row_no int, cells array<string>")


def sniffed(text: str) -> str:
    try:
        return csv.Sniffer().sniff(text[:4096], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def sheet_windows(rows: DataFrame, size: int = 40, columns: int = 24) -> DataFrame:
    """Markdown tables of `size` data rows with their header. The header is the first row with two cells
    or more that are not blank; wider rows are cut with a note."""
    filled = F.size(F.filter("cells", lambda c: F.trim(c) != ""))
    note = F.concat(F.lit("...("), (F.size("cells") - columns).cast("string"), F.lit(" more columns)"))
    cut = F.when(F.size("cells") > columns, F.concat(F.slice("cells", 1, columns), F.array(note))).otherwise(F.col("cells"))
    line = F.concat(F.lit("| "), F.array_join(cut, " | "), F.lit(" |"))
    lines = rows.where(filled > 0).select("raw_file_id", "row_no", filled.alias("filled"), line.alias("line"), F.size(cut).alias("width"))
    head = lines.where("filled >= 2").groupBy("raw_file_id").agg(F.min_by(F.struct("row_no", "line", "width"), "row_no").alias("h"))
    body = lines.join(head, "raw_file_id", "left").where("h is null or row_no <> h.row_no")
    n = F.row_number().over(Window.partitionBy("raw_file_id").orderBy("row_no"))
    body = body.withColumn("window_no", F.floor((n - 1) / size).cast("int"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "line"))), lambda x: x["line"]), "\n")
    out = body.groupBy("raw_file_id", "window_no").agg(F.first("h").alias("h"), joined.alias("rows"), F.min("row_no").alias("row_start"), F.max("row_no").alias("row_end"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("h.width")))
    table = F.when(F.col("h").isNull(), F.col("rows")).otherwise(F.concat_ws("\n", "h.line", rule, "rows"))
    return out.select("raw_file_id", "window_no", table.alias("text"), "row_start", "row_end")


def converted_books(spark: SparkSession, manifest: str, pages: str) -> DataFrame:
    """book, page, text of every page record of a manifest; a missing page file gives an empty text."""
    books = spark.read.json(manifest, multiLine=True).select(F.explode("books").alias("b"))
    records = books.select(F.col("b.title").alias("book"), F.explode("b.page_records").alias("p")).select("book", F.col("p.page").alias("page"), F.substring_index("p.text_file", "/", -1).alias("file"))
    texts = spark.read.text(pages, wholetext=True).select(F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("file"), F.col("value").alias("text"))
    return records.join(texts, "file", "left").select("book", "page", F.coalesce("text", F.lit("")).alias("text"))
