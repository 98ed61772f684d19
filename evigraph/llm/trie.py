"""Prefix trie of conversations, rolled up by centroid decomposition.

Nodes are the distinct sequences of first turns; `nodes` makes them from fingerprints of prefixes,
`rollup` sums what each subtree holds. A prefix's fingerprint is the bitwise xor of hashes of its
turns and their places (two lanes of 64 bits), so it is a running value that can be taken in blocks:
a conversation of any length is cut into blocks by a range sort, and only blocks, never turns, of one
conversation meet in a window.

The decomposition uses as the weight of a node the number of its members, so that the weight of
a subtree is known without any rollup: the sum, over its members, of the turns they have from here
on. Subtrees of at most `limit` weight are cut off first and split, many in one task, by `split`.
What is left above them is split by the same steps as Spark jobs until each component has at most
`limit` nodes, and then by `split` too. A step takes in each component the deepest node with at
least half its weight (the centroid), makes components of the trees below it, adds what the centroid's
subtree holds up the path from it to the component's top, and leaves the rest as a component.

Rows with a null conv_id take no part; null roles and texts are empty. Turns that tie stand in
the order of the md5 of role and text, so that repeated rows are turns like others. Columns of other
names are not looked at; texts of any length are hashed in the first pass and leave it as 16 bytes.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Least and largest weight of a subtree that one task splits; between them a 2^17th of the whole.
LIMIT = (1 << 10, 1 << 20)
#: Rows that may be sent to every executor, of some 50 bytes each. Beyond it tables are dealt by key.
BROADCAST_ROWS = 200_000
#: Children from which a node counts as wide, if few enough nodes do.
WIDE = 100
#: Conversation ids in one chunk of a node's list, and rows split at a time.
CHUNK, TOGETHER = 500, 50_000

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
KEY = ["f1", "f2"]


def head_length(conv: Column) -> Column:
    """The turns that a conversation takes from the first one of its five."""
    return F.crc32(conv.cast("string")) % 9


def base_of(conv: Column) -> Column:
    return conv - conv % 5


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def rebuilt(convs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(turns, convs). turns: conv, depth from 1, f1, f2 (fingerprint up to here), p1, p2 (up to the turn
    before), bytes, length; convs: conv and its rebuilt length."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = convs.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.octet_length(text).cast("long").alias("bytes"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("said"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("said")]
    placed = slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = scratch.put("placed", placed.select("conv", "bytes", F.unhex("said").alias("said"), F.shiftright("at", 33).alias("block"), "at"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = scratch.put("blocks", placed.groupBy("conv", "block").agg(F.count("*").alias("n")))
    lens = blocks.groupBy("conv").agg(F.sum("n").alias("own")).withColumn("h", head_length(F.col("conv"))).withColumn("base", base_of(F.col("conv")))
    lens = lens.join(lens.select(F.col("conv").alias("base"), F.col("own").alias("there")), "base", "left")
    lens = lens.withColumn("head", F.least("h", F.coalesce("there", F.lit(0))))
    lens = scratch.put("lens", lens.withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(lens.select("conv", "h", "head", "length"), "conv")
    inside = Window.partitionBy("conv", "block").orderBy("at")
    own = placed.withColumn("k", F.row_number().over(inside)).join(blocks, ["conv", "block"]).withColumn("pos", F.col("before") + F.col("k"))
    own = scratch.put("own", own.select("conv", "block", "pos", "said", "bytes", "h", "head", "length"))
    # at most eight first turns of one conversation go to at most five
    first = own.where("pos <= 8").select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "said", "bytes")
    heads = first.join(lens.select("base", "conv", "head", "length"), "base").where("depth <= head").withColumn("block", F.lit(-1).cast("long"))
    columns = ["conv", "block", "depth", "said", "bytes", "length"]
    turns = heads.select(*columns).unionByName(own.where("pos > h").withColumn("depth", F.col("pos") - F.col("h") + F.col("head")).select(*columns))
    turns = turns.withColumns({"x1": F.xxhash64(F.lit(1), "depth", "said"), "x2": F.xxhash64(F.lit(2), "depth", "said")}).drop("said")
    turns = scratch.put("turns", turns)
    sums = turns.groupBy("conv", "block").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    sums = sums.select("conv", "block", *[F.coalesce(F.bit_xor(s).over(earlier), F.lit(0)).alias(s) for s in ("s1", "s2")])
    running = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = turns.withColumns({"r1": F.bit_xor("x1").over(running), "r2": F.bit_xor("x2").over(running)}).join(sums, ["conv", "block"])
    f1, f2 = F.col("r1").bitwiseXOR(F.col("s1")), F.col("r2").bitwiseXOR(F.col("s2"))
    run = run.select("conv", "depth", f1.alias("f1"), f2.alias("f2"), f1.bitwiseXOR(F.col("x1")).alias("p1"), f2.bitwiseXOR(F.col("x2")).alias("p2"), "bytes", "length")
    out = scratch.put("run", run)
    scratch.drop("placed", "blocks", "own", "turns")
    return out, lens.select("conv", "length")


def nodes(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row a node: f1, f2, p1, p2, conv (smallest member), depth, n (members), children, parent (its parent's
    conv), size (the subtree's weight), over (its parent's), leaves and saved (its own)."""
    made = turns.groupBy(*KEY).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.count("*").alias("n"),
        F.max("bytes").alias("bytes"), F.sum(F.col("length") - F.col("depth") + 1).alias("size"),
    )
    none = F.lit(None).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.sum(F.col("length") + 1).alias("size")).where("n > 0")
    root = root.select(F.lit(0).cast("long").alias("f1"), F.lit(0).cast("long").alias("f2"), none.alias("p1"), none.alias("p2"), "conv",
                       F.lit(0).cast("long").alias("depth"), "n", F.lit(0).cast("long").alias("bytes"), "size")
    made = scratch.put("made", made.unionByName(root))
    below = made.where("p1 is not null").groupBy(F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count("*").alias("children"))
    made = made.join(below, KEY, "left").withColumn("children", F.coalesce("children", F.lit(0)))
    made = made.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("bytes"))
    made = scratch.put("nodes", made.drop("bytes"))
    # no more than one node in `wide` has as many children: those few go to their children by broadcast
    wide = max(WIDE, made.count() // BROADCAST_ROWS)
    over = lambda df: df.select(F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv").alias("parent"), F.col("size").alias("over"))
    parents = over(made.where(F.col("children") > wide))
    near = made.join(F.broadcast(parents), ["p1", "p2"])
    rest = made.join(F.broadcast(parents), ["p1", "p2"], "left_anti").join(over(made.where((F.col("children") <= wide) & (F.col("children") > 0))), ["p1", "p2"], "left")
    out = scratch.put("tree", near.unionByName(rest))
    scratch.drop("made", "nodes")
    return out


def split(parent: np.ndarray, depth: np.ndarray, size: np.ndarray, top: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sums of values over each node's subtree, by centroid decomposition of all components at once.

    parent: a node's place, its own where it has none; size: weights of subtrees; top: the place of the
    component's top; values: a row a node. A component of weight w takes at most log2(w) + 1 rounds.
    """
    n = len(parent)
    size, top, done, add = size.copy(), top.copy(), np.zeros_like(values), np.zeros_like(values)
    live, everyone, centroid = np.arange(n), np.arange(n), np.full(n, -1)
    while len(live):
        chain = live[2 * size[live] >= size[top[live]]]
        chain = chain[np.lexsort((depth[chain], top[chain]))]
        last = np.append(top[chain][1:] != top[chain][:-1], True)
        centroid[top[chain[last]]] = chain[last]
        c = centroid[top[live]]
        jump = everyone.copy()
        ends = (live == top[live]) | (live == c) | (parent[live] == c)
        jump[live[~ends]] = parent[live[~ends]]
        while not np.array_equal(further := jump[jump], jump):
            jump = further
        under = (jump[live] != top[live]) | (live == c)
        below = np.zeros_like(values)
        np.add.at(below, c[under], values[live[under]])
        cut = chain[last]
        done[cut] = below[cut] + add[cut]
        path = chain[~last]
        at = centroid[top[path]]
        add[path] += below[at]
        size[path] -= size[at]
        top[live] = jump[live]
        live = live[live != c]
    return done


def split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole components, which lie together in a partition, TOGETHER rows or more at a time."""

    def solved(df: pd.DataFrame) -> pd.DataFrame:
        own, above, tops = (df[c].to_numpy(dtype="int64") for c in (["f1", "f2"], ["p1", "p2"], ["t1", "t2"]))
        _, at = np.unique(np.concatenate([own, above, tops]), axis=0, return_inverse=True)
        n = len(df)
        at = at.reshape(-1)
        place = np.full(at.max() + 1, -1)
        place[at[:n]] = np.arange(n)
        top = place[at[2 * n :]]
        parent = np.where(top == np.arange(n), top, place[at[n : 2 * n]])
        values = split(parent, df["depth"].to_numpy(), df["size"].to_numpy(), top, df[["leaves", "saved"]].to_numpy())
        return df.assign(leaves=values[:, 0] + df["add_leaves"], saved=values[:, 1] + df["add_saved"])

    held: list[pd.DataFrame] = []
    for df in batches:
        df[["p1", "p2"]] = df[["p1", "p2"]].fillna(0).astype("int64")
        held.append(df)
        if sum(map(len, held)) >= TOGETHER:
            df = pd.concat(held, ignore_index=True)
            last = (df["t1"] != df["t1"].iat[-1]) | (df["t2"] != df["t2"].iat[-1])
            held = [df[~last]]
            if last.any():
                yield solved(df[last].reset_index(drop=True))
    if sum(map(len, held)):
        yield solved(pd.concat(held, ignore_index=True))


CARRIED = "f1 long, f2 long, p1 long, p2 long, t1 long, t2 long, conv long, depth long, size long, leaves long, saved long, add_leaves long, add_saved long, parent long, n long, children long"


def split_all(tree: DataFrame) -> DataFrame:
    """tree (CARRIED) with the sums of each subtree in leaves and saved; components are of bounded size."""
    names = [c.split()[0] for c in CARRIED.split(", ")]
    filled = tree.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in ("p1", "p2") else c for c in names])
    filled = filled.withColumn("parent", F.when(F.col("depth") > 0, F.col("parent")).otherwise(-1))
    dealt = filled.repartition("t1", "t2").sortWithinPartitions("t1", "t2", "depth")
    out = dealt.mapInPandas(split_batches, CARRIED)
    return out.withColumn("parent", F.when(F.col("depth") > 0, F.col("parent")))


def rollup(tree: DataFrame, turns: DataFrame, scratch: Scratch, limit: int | None = None) -> DataFrame:
    """tree with leaves and saved summed over each node's subtree."""
    n, whole = tree.agg(F.count("*"), F.max("size")).first()
    if not n:
        return tree
    limit = limit or max(LIMIT[0], min(LIMIT[1], whole >> 17))
    zero = F.lit(0).cast("long")
    tree = tree.withColumns({"add_leaves": zero, "add_saved": zero})
    heavy = tree.where(F.col("size") > limit)
    count = heavy.count()
    if not count:
        return split_all(tree.withColumns({"t1": zero, "t2": zero}))
    # of each conversation, the turn at which it leaves the heavy nodes is the top of its light component
    keys = small(heavy.select("f1", "f2"), count)
    parents = small(heavy.select(F.col("f1").alias("p1"), F.col("f2").alias("p2")), count)
    tops = turns.join(parents, ["p1", "p2"], "left_semi").join(keys, KEY, "left_anti").select("conv", F.col("f1").alias("t1"), F.col("f2").alias("t2"))
    light = scratch.put("light", split_all(tree.where(F.col("size") <= limit).join(tops, "conv")))
    sums = light.where("f1 = t1 and f2 = t2").groupBy(F.col("p1").alias("f1"), F.col("p2").alias("f2"))
    sums = sums.agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    heavy = heavy.join(sums, KEY, "left").withColumns(
        {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")} | {"t1": zero, "t2": zero}
    )
    heavy = scratch.put("heavy", heavy.drop("more_leaves", "more_saved"))
    return light.unionByName(_split_heavy(heavy, turns, count, limit, scratch))


def _split_heavy(heavy: DataFrame, turns: DataFrame, count: int, limit: int, scratch: Scratch) -> DataFrame:
    """heavy (CARRIED) with sums over subtrees: components of over `limit` nodes are split by Spark jobs."""
    done, turn, tops, members = None, 0, ["t1", "t2"], None
    while count > limit:
        turn += 1
        big = heavy.groupBy(*tops).agg(F.count("*").alias("rows"), F.max("size").alias("all")).where(F.col("rows") > limit)
        big = scratch.put("big", big)
        if not (k := big.count()):
            break
        if members is None:  # the conversations that stand for heavy nodes, at those nodes
            kept = turns.join(small(heavy.select(*KEY), count), KEY, "left_semi").select("conv", *KEY, "p1", "p2")
            members = scratch.put("members", kept.join(heavy.select("conv").distinct(), "conv", "left_semi"))
        held = heavy.join(small(big, k), tops, "left")
        on_path = F.col("all").isNotNull() & (2 * F.col("size") >= F.col("all"))
        deepest = F.max_by(F.struct("f1", "f2", "depth", "size"), "depth")
        cuts = held.where(on_path).groupBy(*tops).agg(deepest.alias("c"))
        cuts = scratch.put("cuts", cuts.select(*tops, *[F.col("c")[x].alias(y) for x, y in (("f1", "c1"), ("f2", "c2"), ("depth", "c_depth"), ("size", "c_size"))]))
        # a child of the centroid, known by each conversation that passes it, is the top of a new component
        fresh = members.join(small(cuts.select(*tops, F.col("c1").alias("p1"), F.col("c2").alias("p2")), k), ["p1", "p2"])
        fresh = fresh.select("conv", *tops, F.col("f1").alias("n1"), F.col("f2").alias("n2"))
        held = held.join(small(cuts, k), tops, "left").join(fresh, ["conv", *tops], "left")
        is_cut = F.col("f1").eqNullSafe(F.col("c1")) & F.col("f2").eqNullSafe(F.col("c2"))
        moved = F.col("n1").isNotNull() & (F.col("depth") > F.col("c_depth"))
        held = held.withColumns({"is_cut": is_cut, "moved": moved, "path": on_path & ~is_cut})
        held = scratch.put("held", held)
        below = held.where("is_cut or moved").groupBy(*tops).agg(F.sum("leaves").alias("b_leaves"), F.sum("saved").alias("b_saved"))
        held = held.join(small(scratch.put("below", below), k), tops, "left")
        gain = lambda c: F.when(F.col("path"), F.col(f"add_{c}") + F.col(f"b_{c}")).otherwise(F.col(f"add_{c}"))
        cut = held.where("is_cut").withColumns({c: F.col(f"b_{c}") + F.col(f"add_{c}") for c in ("leaves", "saved")})
        cut = scratch.put(f"cut{turn}", cut.select(heavy.columns))
        done = cut if done is None else done.unionByName(cut)
        rest = held.where("not is_cut").withColumns(
            {
                "t1": F.when(F.col("moved"), F.col("n1")).otherwise(F.col("t1")), "t2": F.when(F.col("moved"), F.col("n2")).otherwise(F.col("t2")),
                "size": F.when(F.col("path"), F.col("size") - F.col("c_size")).otherwise(F.col("size")),
                "add_leaves": gain("leaves"), "add_saved": gain("saved"),
            }
        )
        heavy = scratch.put("heavy", rest.select(heavy.columns))
    out = split_all(heavy)
    return out if done is None else out.unionByName(done.select(out.columns))


def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of at most CHUNK ids of one node, from sorted rows: f1, f2, first id, ids joined by commas."""
    for df in batches:
        start = (df["f1"] != df["f1"].shift()) | (df["f2"] != df["f2"].shift())
        run = start.cumsum()
        part = df.groupby(run).cumcount() // CHUNK
        by = df.assign(id=df["conv"].astype(str)).groupby([run, part], sort=False)
        yield by.agg(f1=("f1", "first"), f2=("f2", "first"), conv=("conv", "first"), ids=("id", ",".join)).reset_index(drop=True)


def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The SHA-256 of all ids of each node, from sorted runs; only the hash's state is held."""
    key, state = None, None
    for df in batches:
        out = []
        for f1, f2, ids in zip(df["f1"], df["f2"], df["ids"], strict=True):
            if (f1, f2) != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (f1, f2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pd.DataFrame(out, columns=["f1", "f2", "sha"])
    if key:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=["f1", "f2", "sha"])


def ends_sha(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """f1, f2, sha of each node at which conversations end.

    A node's ids are sorted in ranges of the whole and come as runs; one pass over the runs makes the
    hash, which is sequential by its definition, so a node that a third of all conversations end at is
    never held in memory.
    """
    zero = F.lit(0).cast("long")
    ends = turns.where("depth = length").select(*KEY, "conv").unionByName(convs.where("length = 0").select(zero.alias("f1"), zero.alias("f2"), "conv"))
    runs = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInPandas(listed, "f1 long, f2 long, conv long, ids string")
    return runs.repartition(*KEY).sortWithinPartitions(*KEY, "conv").mapInPandas(hashed, "f1 long, f2 long, sha string")


def trie(convs: DataFrame, limit: int | None = None) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations (conv_id, turn, role, text).

    limit: the largest weight of a component that is split in one task (see LIMIT).
    """
    scratch = Scratch(convs.sparkSession)
    turns, each = rebuilt(convs, scratch)
    tree = rollup(nodes(turns, each, scratch), turns, scratch, limit)
    out = tree.join(ends_sha(turns, each), KEY, "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
    out = Scratch(convs.sparkSession).put("trie", out)
    scratch.drop_all()
    return out
