"""Audit of how filters interact: what each removes after any others, and what it costs in labels.

One pass over the texts stores, for every filter, the table of the rows that fail it. Left-semi and
left-anti joins with these tables then split the rows, filter by filter, into classes of the same
failures; the survivors of any prefix of any order are the classes that fail none of its filters, and
its removals, redundancies and label losses are sums over classes. So 2 joins a filter on slim rows
serve all orders, and only the counts of at most 2^filters classes a part go on.

Rows are told apart by a number of their own, given when the slim table is written; repeated rows and
repeated or null keys count each on its own. A null text is empty; a null part is the empty string. A row is
an exact copy if its text is that of a row with a smaller key; a null key is neither smaller nor has
a smaller one. A row has a label if any label row of its key has it; null labels and labels of other
keys count for nothing. Texts of any length are read whole and never leave the first pass. Columns of
any other name in the tables are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, word_array

#: Failure conditions by (text, words): letters A to D of the contract.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 100,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
    "C": lambda text, words: 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 10 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
#: The name of the filter that fails later copies of a text.
COPIES = "E"
#: Filters that may be audited in all their orders; the report has filters! * filters rows a part.
MOST = 7


def failing_ids(docs: DataFrame, scratch: Scratch, filters: dict, copies: str | None, key: str, text: str, part: str) -> tuple[DataFrame, DataFrame]:
    """(slim, failing): slim has _row, _key and _part; failing has _filter and _row, one folder a filter."""
    read = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.coalesce(F.col(part), F.lit("")).alias("_part"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    ).withColumn("_words", word_array(F.col("_text")))
    failed = F.filter(F.array(*[F.when(f(F.col("_text"), F.col("_words")), F.lit(name)) for name, f in filters.items()]), lambda x: x.isNotNull())
    slim = scratch.put("slim", read.select("_row", "_key", "_part", F.md5("_text").alias("_same"), failed.alias("_failed")))
    failing = slim.select(F.explode("_failed").alias("_filter"), "_row")
    if copies:
        # the first of each text by its key: no join has the text alone as its key, however often it occurs
        firsts = slim.groupBy("_same").agg(F.min("_key").alias("_key"))
        later = slim.where("_key is not null").join(firsts, ["_same", "_key"], "left_anti")
        failing = failing.unionByName(later.select(F.lit(copies).alias("_filter"), "_row"))
    path = f"{scratch.dir}/failing"
    failing.write.partitionBy("_filter").parquet(path)
    scratch.at["failing"] = path
    return slim, docs.sparkSession.read.schema("_row long, _filter string").parquet(path)


def classes(
    docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, copies: str | None = COPIES, key: str = "doc_id", text: str = "text", part: str = "lang",
    flags: tuple[str, ...] = ("quality", "toxic"),
) -> DataFrame:
    """_part, _failed (bits of the failed filters, in their order), n, and the rows with each flag (a label equal to 1)."""
    scratch = Scratch(docs.sparkSession)
    names = [*filters, *([copies] if copies else [])]
    slim, failing = failing_ids(docs, scratch, filters, copies, key, text, part)
    marked = labels.groupBy(F.col(key).alias("_key")).agg(*[F.coalesce(F.max((F.col(f) == 1).cast("int")), F.lit(0)).alias(f"_{f}") for f in flags])
    rows = slim.join(marked, "_key", "left").select("_row", "_part", F.lit(0).alias("_failed"), *[F.coalesce(f"_{f}", F.lit(0)).alias(f"_{f}") for f in flags])
    rows = scratch.put("rows", rows)
    for i, name in enumerate(names):
        ids = failing.where(F.col("_filter") == name).select("_row")
        gone = rows.join(ids, "_row", "left_semi").withColumn("_failed", F.col("_failed").bitwiseOR(F.lit(1 << i)))
        rows = scratch.put("rows", gone.unionByName(rows.join(ids, "_row", "left_anti")))
    counted = rows.groupBy("_part", "_failed").agg(F.count("*").alias("n"), *[F.sum(f"_{f}").cast("long").alias(f"_{f}") for f in flags])
    out = Scratch(docs.sparkSession).put("classes", counted)
    scratch.drop_all()
    return out


def audit(
    docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, copies: str | None = COPIES, key: str = "doc_id", text: str = "text", part: str = "lang",
    lost: dict[str, str] | None = None,
) -> DataFrame:
    """Per part, order of all filters and step: kept, removed, redundant, unique_fails, what is lost of each
    label (lost: column by label) and shapley, the filter's removals over all orders (all long)."""
    lost = {"good_lost": "quality", "toxic_lost": "toxic"} if lost is None else lost
    names = [*filters, *([copies] if copies else [])]
    if len(names) > MOST or any(len(n) != 1 for n in names):
        raise ValueError(f"give at most {MOST} filters, each named by one letter")
    counted = classes(docs, labels, filters, copies, key, text, part, tuple(lost.values()))
    bit = {n: 1 << i for i, n in enumerate(names)}
    steps = []  # (order, step, bits of the filters before, bit of this one)
    for order in itertools.permutations(names):
        before = 0
        for k, n in enumerate(order, 1):
            steps.append(("".join(order), k, before, bit[n]))
            before |= bit[n]
    # every order meets only 2^(n-1) * n pairs of a set of filters and the next one
    pairs = sorted({s[2:] for s in steps})
    pair = F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("bit")) for b, f in pairs]))
    met = counted.withColumn("_pair", pair).select("*", "_pair.before", "_pair.bit")
    alive = F.col("_failed").bitwiseAND(F.col("before")) == 0
    fails = F.col("_failed").bitwiseAND(F.col("bit")) != 0
    total = lambda cond, what="n": F.sum(F.when(cond, F.col(what)).otherwise(0)).cast("long")
    found = met.groupBy("_part", "before", "bit").agg(
        total(alive & ~fails).alias("kept"), total(alive & fails).alias("removed"), total(~alive & fails).alias("redundant"),
        total(F.col("_failed") == F.col("bit")).alias("unique_fails"), *[total(alive & fails, f"_{f}").alias(c) for c, f in lost.items()],
    )
    orders = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, bit int")
    # the orders are as many rows as the filters' number gives, whatever the data
    out = found.join(F.broadcast(orders), ["before", "bit"])
    out = out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("_part", "bit")))
    return out.select(F.col("_part").alias("part"), "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley")
