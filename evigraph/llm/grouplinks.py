"""Links between the members of overlapping groups, and the classes that they form.

Candidate groups (rows of one key) may be as large as a third of the input. Each hub round checks one
member of a group against those that are not yet in its class, so the copies of a text become one
class in work that is linear in the group. What then still lies in several classes of one group is
checked by `finish`, without regard to how large the group is, so that no link between two classes is
lost and the classes are those of all links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rounds with one hub a group before `finish`.
HUB_ROUNDS = 4
#: Rows (a few longs each) for which one task is enough; larger tables are dealt out.
TASK_ROWS = 500_000
#: What a round compares of a member.
MEMBER = ("id", "n", "cap", "mark", "comp")


def _dealt(table: DataFrame, rows: int) -> DataFrame:
    """A written table in as few partitions as its rows call for: with one, nothing is shuffled."""
    return table.coalesce(math.ceil(rows / TASK_ROWS) or 1)


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """links (a, b long) -> id, comp: the class of every linked id, named by one of its ids.

    Each round every node moves to the neighbour that ranks highest, by number of neighbours and then
    by a fresh random order, unless it ranks higher itself, and edges are renamed. Of any edge the
    lower end moves, so the number of nodes with edges falls by a constant factor a round, whatever
    the shape of the graph, and a star goes in one. Rounds are written tables, so no lineage grows;
    each replaces that of the round before.
    """
    scratch = scratch or Scratch(links.sparkSession)
    edges = scratch.put("edges", links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # each round is few jobs: only edges are counted anew, and they bound what moves
    left = edges.count()
    edges = _dealt(edges, left)
    names = scratch.put("names", edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("comp", F.col("id")))
    nodes = names.count()
    names = _dealt(names, nodes)
    turn = 0
    while left:
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # as a string the turn is no part of compiled code, which all turns then share
        chance = F.xxhash64(F.lit(str(turn)), "a").bitwiseAND(F.lit(0xFFFFFFFF))
        ranks = both.groupBy("a").agg(F.count("*").alias("d")).select("a", (F.shiftleft("d", 32) + chance).alias("r"))
        seen = both.join(ranks.select(F.col("a").alias("b"), F.col("r").alias("rb")), "b").groupBy("a").agg(F.max("rb").alias("rb"), F.max_by("b", "rb").alias("to"))
        move = _dealt(scratch.put("move", seen.join(ranks, "a").where("rb > r").select("a", "to")), min(nodes, 2 * left))
        to_a, to_b = move.select("a", F.col("to").alias("ta")), move.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        edges = edges.join(to_a, "a", "left").join(to_b, "b", "left")
        edges = edges.select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")).where("a <> b")
        edges = scratch.put("edges", edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        left = edges.count()
        edges = _dealt(edges, left)
        names = names.join(move.withColumnRenamed("a", "comp"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
        names = _dealt(scratch.put("names", names), nodes)
    scratch.drop("edges", "move")
    return names


def shared(members: DataFrame, cap: Column) -> DataFrame:
    """The members (key, id, n and more) of keys with two ids or more, with their cap, each once.

    Members go through one exchange, by key; a member whose cap is below every n of its key has no
    partner there and goes too.
    """
    own = Window.partitionBy("key")
    seen = members.withColumns({"_lo": F.min("id").over(own), "_hi": F.max("id").over(own), "_least": F.min("n").over(own)})
    return seen.where("_lo < _hi").withColumn("cap", cap).where("cap >= _least").drop("_lo", "_hi", "_least").dropDuplicates(["key", "id"])


def hub(choice: Column) -> Column:
    """The member of a group in which choice is greatest, as the partner of all others."""
    return F.max_by(F.struct(*MEMBER), choice).over(Window.partitionBy("key"))


def before(order: Column) -> Column:
    """The member of a group that comes before each in this order, as its partner."""
    return F.lag(F.struct(*MEMBER)).over(Window.partitionBy("key").orderBy(order))


def link_groups(
    held: DataFrame, check: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], DataFrame], scratch: Scratch, max_bits: str = "64",
    comps: DataFrame | None = None, rounds: Sequence[Sequence[Column]] | None = None,
) -> DataFrame:
    """held: key, id, n, cap, mark (long) -> id, comp of all ids with a link.

    Two members of a key can only link if the n of each is at most the cap of the other; where there is
    no such bound, give 0 for both. Marks that differ in more than max_bits bits rule a link out;
    max_bits is SQL with {0} and {1} for the n of both. check takes distinct pairs (a < b) and returns
    those that are links. finish takes the members (with comp) of groups that still hold several
    classes and returns all links (a, b) between members of one key and of different classes. comps:
    classes known before, if any, written as "comps" in scratch; they are in the result. rounds: the
    partners (`hub`, `before`) that each member is checked against in each round before `finish`.
    """
    if rounds is None:
        # the member with the most room is the likeliest partner of the others
        rounds = [[hub(F.col("cap") if turn == 0 else F.xxhash64(F.lit(str(turn)), "id"))] for turn in range(HUB_ROUNDS)]
    own = Window.partitionBy("key")
    for turn in range(len(rounds) + 1):
        named = held.withColumn("comp", F.col("id")) if comps is None else held.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        if comps is not None:
            named = named.withColumns({"_c0": F.min("comp").over(own), "_c1": F.max("comp").over(own)}).where("_c0 < _c1").drop("_c0", "_c1")
            named = scratch.put("held", named)
            if named.isEmpty():
                break
        if turn < len(rounds):
            meet = f"comp <> hub.comp and n <= hub.cap and hub.n <= cap and bit_count(mark ^ hub.mark) <= {max_bits.format('n', 'hub.n')}"
            pairs = [named.withColumn("hub", x).where(meet).select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")) for x in rounds[turn]]
            new = check(reduce(DataFrame.unionByName, pairs).distinct())
        else:
            new = finish(named)
        new = scratch.put("links", new)
        found = new.count()
        if found or comps is None:
            comps = scratch.put("comps", _merged(comps, _dealt(new, found), scratch))
            comps = _dealt(comps, comps.count())
        held = named.drop("comp")
    scratch.drop_all(but=("comps",))
    return comps


def _merged(comps: DataFrame | None, new: DataFrame, scratch: Scratch) -> DataFrame:
    """comps (None: none yet) with the classes that the new links join."""
    if comps is None:
        return components(new, scratch)
    side = lambda k: comps.select(F.col("id").alias(k), F.col("comp").alias(f"{k}_c"))
    edges = new.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"))
    moves = components(edges, scratch).select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    # a class that had one member until now has no row yet
    first = moves.select(F.col("comp").alias("id")).join(comps.select("id"), "id", "left_anti").withColumn("comp", F.col("id"))
    return comps.unionByName(first).join(moves, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))


def pairs_across(named: DataFrame, max_bits: str = "64", more: str = "true") -> DataFrame:
    """The pairs of members of one key in different classes that bounds and marks allow to link.

    Pairs are compared inside the join; only those that pass are listed. more is a further condition in
    SQL; of the other member, columns end in 2.
    """
    other = named.toDF(*[c if c == "key" else f"{c}2" for c in named.columns])
    meet = f"comp < comp2 and n <= cap2 and n2 <= cap and bit_count(mark ^ mark2) <= {max_bits.format('n', 'n2')} and {more}"
    return named.join(other, "key").where(meet).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
