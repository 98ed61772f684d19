"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

`targets` shares a budget among sources by weight, clamps every source at `max_epochs` times its
size and reshares the excess by weight until none is above its cap. It works on one row a source.
`take` turns a source's target into repetitions: with target = (q + f) * source size, every document
is taken q times whole, and in a seeded random order of the source's documents one more time until
f times the source's size is used up; the document at that boundary is taken in part. So the words
taken equal the floor of the target exactly, and no document is taken more than ceil(q + f) times.

Nulls: a null text has size 0, a null source is a source of its own and comes last. An empty table
gives an empty result; sources without words get target 0. Repeated rows are documents of their own;
rows equal in key and size are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize, word_array

#: About so many documents share one task while positions in a source are summed up.
CHUNK_ROWS = 4096


def targets(
    sources: DataFrame, size: str = "source_size", weight: str = "weight", budget_share: tuple[int, int] = (3, 2), max_epochs: int = 2
) -> DataFrame:
    """sources (one row each: size long, weight integer) with target double.

    The budget is budget_share[0] / budget_share[1] of all sizes. Water level in exact integers: in
    each round the sources whose cap lies below their share are clamped, and what they leave is
    shared again; two sums come to the driver a round. Rounds end when no further source is clamped.
    """
    num, den = budget_share
    held = sources.select(F.col(size).cast("decimal(38,0)").alias("s"), F.col(weight).cast("decimal(38,0)").alias("w"))
    total = held.agg(F.sum("s")).first()[0] or 0
    clamp = F.lit(False)
    clamped = -1
    while True:
        r = held.agg(
            F.count_if(clamp).alias("n"),
            F.sum(F.when(clamp, max_epochs * F.col("s")).otherwise(0)).alias("c"),
            F.sum(F.when(clamp, 0).otherwise(F.col("w"))).alias("w"),
        ).first()
        rest, weights = num * int(total) - den * int(r.c or 0), den * int(r.w or 0)  # both times den
        if r.n == clamped or weights <= 0:
            break
        clamped = r.n
        # cap < weight * rest / weights, in integers
        clamp = _above(F.col("s"), F.col("w"), max_epochs, rest, weights)
    size_c, weight_c = F.col(size).cast("decimal(38,0)"), F.col(weight).cast("decimal(38,0)")
    capped = (max_epochs * F.col(size)).cast("double")
    if weights <= 0:
        return sources.withColumn("target", capped)
    share = (F.col(weight) * F.lit(rest)).cast("double") / F.lit(weights).cast("double")
    return sources.withColumn("target", F.when(_above(size_c, weight_c, max_epochs, rest, weights), capped).otherwise(share))


def _above(size: Column, weight: Column, max_epochs: int, rest: int, weights: int) -> Column:
    big = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    return max_epochs * size * big(weights) < weight * big(rest)


def take(docs: DataFrame, shared: DataFrame, key: str, source: str, size: str, seed: int = 17) -> DataFrame:
    """docs with source_size, target, taken (words) and copies (whole repetitions, the part rounded).

    docs: key, source, size; shared: source, source_size, target of each source.

    The position of a document in its source's seeded order is the words of the earlier ranges of the
    hash plus a running sum within its own range; ranges are cut fine enough that none is large,
    so a source with a third of all rows is spread over many tasks.
    """
    n = docs.count()
    ranges = max(1, -(-n // CHUNK_ROWS))
    order = F.xxhash64(F.lit(seed), F.col(key), F.col(size))
    placed = docs.withColumn("_m_h", order).withColumn("_m_r", F.pmod(F.shiftrightunsigned("_m_h", 20), F.lit(ranges)))
    sums = placed.groupBy(F.col(source).alias("_m_src"), F.col("_m_r").alias("_m_rr")).agg(F.sum(size).alias("_m_sum"))
    before = Window.partitionBy("_m_src").orderBy("_m_rr").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_m_before", F.coalesce(F.sum("_m_sum").over(before), F.lit(0)))
    sums = sums.join(shared.select(F.col(source).alias("_m_s2"), "source_size", "target"), F.col("_m_src").eqNullSafe(F.col("_m_s2")))
    # the running sum comes before the join, which may then be dealt in any way
    own = Window.partitionBy(F.col(source), "_m_r").orderBy("_m_h", key).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_m_own", F.coalesce(F.sum(size).over(own), F.lit(0)))
    out = placed.join(sums, F.col(source).eqNullSafe(F.col("_m_src")) & (F.col("_m_r") == F.col("_m_rr")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    extra = F.floor(F.col("target")).cast("long") - whole * F.col("source_size")
    at = F.col("_m_before") + F.col("_m_own")
    part = F.greatest(F.lit(0), F.least(F.col(size), extra - at))
    out = out.withColumns(
        {
            "taken": (whole * F.col(size) + part).cast("long"),
            "copies": (whole + F.when((part > 0) & (2 * part >= F.col(size)), 1).otherwise(0)).cast("long"),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_m_")])


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def cycle_weights(sources: DataFrame, source: str, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """sources (one row each) with weight: the cycle's numbers by code point of the source, null last."""
    rank = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(x) for x in cycle]), (F.pmod(rank, F.lit(len(cycle))) + 1).cast("int"))
    return sources.withColumn("weight", pick.cast("long"))


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", budget_share: tuple[int, int] = (3, 2),
    max_epochs: int = 2, seed: int = 17, carry: tuple = (),
) -> DataFrame:
    """key, source, the carried columns, size, source_size, target, taken and copies of every document."""
    more = [c for c in carry if c not in (key, source)]
    sized = materialize(docs.select(key, source, *more, word_count(F.col(text)).alias("size")))
    shared = materialize(cycle_weights(sized.groupBy(source).agg(F.sum("size").alias("source_size")), source))
    return take(sized, targets(shared, budget_share=budget_share, max_epochs=max_epochs), key, source, "size", seed)


#: Ranges of the seeded order (as bits of the hash) and sources that may be sent to every executor.
RANGE_BITS, BROADCAST_SOURCES = 16, 100_000


def repeat(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", budget_share: tuple[int, int] = (3, 2), max_epochs: int = 2, seed: int = 17,
) -> DataFrame:
    """docs as the mix takes them: each document in whole copies, and of one document a source the first words.

    Sizes are summed by source and range of the seeded order; in each source only the range that holds
    the end of the last, partial round is sorted. The place of that end goes to all rows, so each row
    is decided where it lies and no text is shuffled. Rows that tie at the end share what is left of
    its words. Rows equal in key, or without one, tie; other columns of any name are kept as they are.
    """
    spark = docs.sparkSession
    scratch, ends = Scratch(spark), Scratch(spark)
    own = docs.select(
        F.col(source).alias("_src"), F.xxhash64(F.lit(seed), F.col(key)).alias("_h"), F.col(text).alias("_text"), F.struct(*docs.columns).alias("_doc")
    )
    sized = scratch.put("sized", own.select("_src", "_h", word_count(F.col("_text")).alias("size")).withColumn("_r", F.shiftright("_h", 64 - RANGE_BITS)))
    shared = scratch.put("shared", cycle_weights(sized.groupBy("_src").agg(F.sum("size").alias("source_size")), "_src"))
    shared = targets(shared, budget_share=budget_share, max_epochs=max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    shared = shared.withColumn("whole", whole).withColumn("extra", F.floor("target").cast("long") - F.col("whole") * F.col("source_size"))
    shared = scratch.put("extras", shared.select("_src", "whole", "extra"))
    earlier = lambda by: Window.partitionBy("_src").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    reach = lambda sums, by: sums.withColumn("before", F.coalesce(F.sum("s").over(earlier(by)), F.lit(0)))
    at = lambda name: shared.select(F.col("_src").alias("_src2"), F.col("extra").alias(name))
    same = F.col("_src").eqNullSafe(F.col("_src2"))
    ranges = reach(sized.groupBy("_src", "_r").agg(F.sum("size").alias("s")), "_r").join(at("extra"), same)
    ranges = ranges.where("before <= extra and extra < before + s").select("_src2", F.col("_r").alias("_r2"), (F.col("extra") - F.col("before")).alias("extra"))
    last = sized.join(scratch.put("ranges", ranges), same & (F.col("_r") == F.col("_r2")))
    last = reach(last.groupBy("_src", "_h", "extra").agg(F.sum("size").alias("s"), F.count("*").alias("k")), "_h")
    last = last.where("before <= extra and extra < before + s")
    last = last.select(F.col("_src").alias("_src2"), F.col("_h").alias("end"), F.floor((F.col("extra") - F.col("before")) / F.col("k")).alias("part"))
    found = ends.put("ends", shared.select("_src", "whole").join(last, same, "left").select(F.col("_src").alias("_src3"), "whole", "end", "part"))
    scratch.drop_all()
    found = F.broadcast(found) if found.count() <= BROADCAST_SOURCES else found
    out = own.join(found, F.col("_src").eqNullSafe(F.col("_src3")))
    copies = (F.col("whole") + F.when(F.col("_h") < F.col("end"), 1).otherwise(0)).cast("int")
    part = F.when((F.col("_h") == F.col("end")) & (F.col("part") > 0), F.array(F.col("part"))).otherwise(F.array().cast("array<bigint>"))
    out = out.select("_doc", "_text", F.explode(F.concat(F.array_repeat(F.lit(-1).cast("long"), copies), part)).alias("_words"))
    cut = F.array_join(F.slice(word_array(F.col("_text")), F.lit(1), F.col("_words").cast("int")), " ")
    new = F.when(F.col("_words") < 0, F.col("_text")).otherwise(cut)
    return out.select(*[new.alias(c) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns])
