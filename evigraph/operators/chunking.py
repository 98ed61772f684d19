"""Segmentation: lines, headings, sections, overlapping chunks and their locators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK, OVERLAP = 700, 80
HEADING = r"^(#{1,6})\s+(\S.*)$"
CJK_HEADING = r"^第[一二三四五六七八九十百零〇0-9]+[章节篇部]\s*\S*"


def line_records(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (from 1), line without closing blanks; \\r\\n and \\r end lines too."""
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n")
    lines = docs.select(key, F.posexplode(F.split(plain, "\n", -1)).alias("pos", "line"))
    return lines.select(key, (F.col("pos") + 1).alias("line_no"), F.rtrim("line").alias("line"))


def heading_level(line: Column) -> Column:
    """1-6 for a marked heading, 1 for a short chapter line, else null."""
    marks = F.regexp_extract(line, HEADING, 1)
    return F.when(marks != "", F.length(marks)).when((F.length(line) <= 48) & line.rlike(CJK_HEADING), F.lit(1))


def draft_sections(lines: DataFrame, level: Column, key: str = "doc_id") -> DataFrame:
    """Lines with section_no: a heading opens a section and is not part of its body."""
    up_to = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("level", level).withColumn("section_no", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(up_to))


def compose_sections(drafted: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, section_no, title, level, content (non-blank lines, trimmed, joined by \\n), line_start,
    line_end, char_count of every section with a body."""
    body = drafted.where("level is null").withColumn("line", F.trim("line")).where("line <> ''")
    heads = drafted.where("level is not null").select(key, "section_no", "level", F.regexp_replace(F.trim("line"), r"^#{1,6}\s+", "").alias("title"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    grouped = body.groupBy(key, "section_no").agg(text.alias("content"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"))
    out = grouped.join(heads, [key, "section_no"], "left")
    return out.select(key, "section_no", "title", "level", "content", "line_start", "line_end", F.length("content").alias("char_count"))


def line_spans(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Non-blank trimmed lines with char_start and char_end in their composed text."""
    body = lines.withColumn("line", F.trim("line")).where("line <> ''")
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))
    return body.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length("line"))


def chunk_count(n: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """How many windows a text of n characters has, in closed form."""
    return F.greatest(F.lit(1), F.ceil((n - overlap) / F.lit(float(size - overlap))).cast("int"))


def chunks(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """keys, chunk_no, char_start, char_end, chunk (trimmed), char_count. Blank windows are left out."""
    # the text is cut once into blocks of a step; a window is a block and the beginning of the next, so no
    # window scans the text from its start
    step = size - overlap
    n = F.length(text)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    held = docs.where(n > 0).select(*keys, n.alias("_n"), chunk_count(n, size, overlap).alias("_windows"), blocks.alias("_blocks"))
    whole = F.zip_with("_blocks", F.slice("_blocks", F.lit(2), F.size("_blocks")), lambda x, y: F.concat(x, F.substring(F.coalesce(y, F.lit("")), 1, overlap)))
    windows = held.select(*keys, "_n", F.posexplode(F.slice(whole, F.lit(1), F.col("_windows"))).alias("chunk_no", "_cut"))
    out = windows.select(
        *keys, "chunk_no", (F.col("chunk_no") * step).alias("char_start"), F.least(F.col("chunk_no") * step + size, "_n").alias("char_end"),
        F.regexp_replace("_cut", r"(?U)^\s+|\s+$", "").alias("chunk"),
    )
    return out.withColumn("char_count", F.length("chunk")).where("char_count > 0")


def locate(windows: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first and last line that each chunk window overlaps."""
    w = windows.select(key, "chunk_no", F.col("char_start").alias("ws"), F.col("char_end").alias("we"))
    met = w.join(spans, key).where("char_start < we and char_end > ws")
    return met.groupBy(key, "chunk_no").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.count("*").alias("n_lines"))


def row_windows(rows: DataFrame, group: str, order: list[str], size: int = 40) -> DataFrame:
    """Windows of `size` rows of each group with row_start and row_end (from 1)."""
    numbered = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    window = F.floor((F.col("_rn") - 1) / size).cast("int")
    return numbered.groupBy(group, window.alias("window_no")).agg(F.min("_rn").alias("row_start"), F.max("_rn").alias("row_end"), F.count("*").alias("n_rows"))


def repeated_edge_lines(lines: DataFrame, key: str, group: str, min_count: int = 3, edge: int = 2, limit: int = 40) -> DataFrame:
    """Short lines at the edges of a group's pages that at least max(min_count, pages / 4) pages have."""
    page = Window.partitionBy(key)
    body = lines.where(F.trim("line") != "").withColumn("line", F.trim("line"))
    body = body.withColumn("r", F.row_number().over(page.orderBy("line_no"))).withColumn("n", F.count("*").over(page))
    at_edge = body.where((F.length("line") <= limit) & ((F.col("r") <= edge) | (F.col("r") > F.col("n") - edge)))
    pages = lines.groupBy(group).agg(F.count_distinct(key).alias("pages"))
    seen = at_edge.select(group, key, "line").distinct().groupBy(group, "line").agg(F.count("*").alias("c"))
    return seen.join(pages, group).where(F.col("c") >= F.greatest(F.lit(min_count), F.floor(F.col("pages") / 4))).select(group, "line", "c")


def filter_repeated(lines: DataFrame, repeated: DataFrame, key: str, group: str, edge: int = 2) -> DataFrame:
    """Non-blank lines without the repeated ones at page edges."""
    page = Window.partitionBy(key)
    body = lines.where(F.trim("line") != "").withColumn("line", F.trim("line"))
    body = body.withColumn("r", F.row_number().over(page.orderBy("line_no"))).withColumn("n", F.count("*").over(page))
    body = body.withColumn("at_edge", (F.col("r") <= edge) | (F.col("r") > F.col("n") - edge))
    marked = body.join(repeated.select(group, "line", F.lit(True).alias("rep")), [group, "line"], "left")
    return marked.where(~(F.col("at_edge") & F.coalesce("rep", F.lit(False)))).select(group, key, "line_no", "line")
