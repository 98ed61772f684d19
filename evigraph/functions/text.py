"""Text functions as column expressions: ids, tokens, sentences, names, quotes.

`zh_medical` and `latin` are the two lexicon packs: patterns and word lists are data, so the same
expressions serve both.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\u4e00-\\u9fa5"
SENTENCE_END = "。！？!?；;"


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and the first 16 hex digits of the SHA-256 of the parts joined by |; null prints as None."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, 16))


def quote_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def collapse(text: Column) -> Column:
    """Runs of white space as one space, without any at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def trim_quote(text: Column, limit: int) -> Column:
    return F.substring(collapse(text), 1, limit)


def truncate(text: Column, limit: int | Column) -> Column:
    """text if it fits, else its first limit - 1 characters without closing marks and an ellipsis."""
    n = F.lit(limit) if isinstance(limit, int) else limit
    cut = F.regexp_replace(F.substring(text, F.lit(1), n - 1), "[ ，,；;。]+$", "")
    return F.when(F.length(text) <= n, text).otherwise(F.concat(cut, F.lit("…")))


def normalize_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", ""))


def normalize_term(term: Column) -> Column:
    """Lower case, without parenthesised parts and separators."""
    out = F.lower(F.coalesce(term, F.lit("")))
    out = F.regexp_replace(F.regexp_replace(out, r"\([^)]*\)", ""), r"（[^）]*）", "")
    return F.regexp_replace(out, r"[\s_\-·,，。；;:：/\\()\[\]（）【】]+", "")


def latin_words(text: Column) -> Column:
    """Lower-cased runs of two or more ASCII letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-zA-Z0-9_]{2,})"), F.lit(1))


def cjk_grams(text: Column, sizes: tuple[int, ...] = (2, 3), whole: int = 8) -> Column:
    """All 2- and 3-grams of runs of two or more ideographs, and runs of at most `whole` themselves."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"([{CJK}]{{2,}})"), F.lit(1))

    def of(run: Column) -> Column:
        grams = [
            F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
            for n in sizes
        ]
        own = F.when(F.length(run) <= whole, F.array(run)).otherwise(F.array().cast("array<string>"))
        return F.concat(*grams, own)

    return F.flatten(F.transform(runs, of))


def tokens(text: Column) -> Column:
    """Every token of a text with repeats: Latin words, then ideograph grams where there are any."""
    has_cjk = F.coalesce(text, F.lit("")).rlike(f"[{CJK}]{{2}}")
    return F.when(has_cjk, F.concat(latin_words(text), cjk_grams(text))).otherwise(latin_words(text))


def token_list(text: str | None) -> list[str]:
    """What `tokens` gives, for one text in Python."""
    text = text or ""
    out = re.findall("[a-zA-Z0-9_]{2,}", text.lower())
    for run in re.findall(f"[{CJK}]{{2,}}", text):
        out += [run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1)]
        out += [run] if len(run) <= 8 else []
    return out


def sentences(text: Column) -> Column:
    """Non-empty sentences, cut after 。！？!?；; and trimmed."""
    parts = F.split(F.coalesce(text, F.lit("")), f"(?<=[{SENTENCE_END}])", -1)
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def hash_bucket(term: Column, dims: int = 256) -> Column:
    """The first 64 bits of the term's SHA-256, modulo a power of two of at most 256."""
    return F.conv(F.substring(F.sha2(term, 256), 15, 2), 16, 10).cast("int") % dims


def hash_sign(term: Column) -> Column:
    digit = F.conv(F.substring(F.sha2(F.concat(term, F.lit(":sign")), 256), 16, 1), 16, 10).cast("int")
    return F.when(digit % 2 == 0, 1).otherwise(-1)


def contains_any(text: Column, markers: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def first_marker(text: Column, table: list[tuple[tuple[str, ...], str]], other: str | None) -> Column:
    """The value of the first row of the table with a marker that the text contains."""
    out = F.lit(other)
    for markers, value in reversed(table):
        out = F.when(contains_any(text, markers), F.lit(value)).otherwise(out)
    return out
