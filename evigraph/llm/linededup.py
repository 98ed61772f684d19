"""Fuzzy line dedup, in DataFrame functions only.

A line's words are its runs of ASCII letters, digits and other characters beyond ASCII, after
lower-casing; lines with the same words are copies. Lines of `MIN_WORDS` words or more are also
compared fuzzily: two are linked if the edit similarity of their word sequences is at least
`SIMILARITY`, whatever their length.

Candidates come by pigeonhole on runs of words. Lines of up to `SHORT` words list pairs of neighbours:
an edit breaks at most two, so lines d edits apart that both list 2 d + 1 pairs, in one order of all,
share one. Lines of `BOTH` words or more list runs of `RUN` words that start at their `ANCHORS` first
words in one order of all words; an edit breaks at most RUN of these and moves one out, so a link of one
edit can't be hidden. With more edits a link is missed if none of the anchors is
left, and tests hold the share that is found to 0.9 at the very similarity bound.
Lines of `BOTH` to `SHORT` words list both, so that each linked pair shares a kind. In the order, short
words come last, and so do runs that very many lines list, by counts over all lines. A SimHash of 64
bits can't take the place of these runs: lines at this similarity differ in some 13 of its bits on
average, and no blocks select by that (README).

Parity bitmaps of the words, of which an edit flips at most two bits, rule out most other candidates
before they are listed, so that only lines of the others are read again for their words. Small groups
are compared in all pairs; `grouplinks` turns large ones into classes, and there the words of two lines,
each as often as it occurs, rule out most of what bitmaps let pass. Words are compared
by 64-bit hashes; of each class the first occurrence, by doc_id and position, stays.

Lines are named by a 64-bit hash of their words, and copies must also agree in a second hash. Nulls: a
null text has no lines; a null doc_id comes first in the order. Lines without a word are never
removed. Empty tables give empty results. Rows equal in doc_id and text are one document and are
treated alike; of equal ids with different texts, the text with the lower hash comes first. Texts and
lines of any length are taken whole. Extra columns of any name are kept as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .grouplinks import before, components, hub, link_groups, pairs_across, shared

MIN_WORDS, SIMILARITY = 4, 0.8
#: Lines of up to SHORT words list pairs of words, those of BOTH words or more runs of RUN at anchors.
SHORT, BOTH, ANCHORS, RUN = 14, 11, 10, 4
#: Runs in reserve for those that very many lines list.
SPARE = 6
#: Words with fewer characters than this come last in the order.
COMMON_CHARS = 4
#: Buckets of runs that are counted (one byte each goes into the plan).
BUCKETS = 1 << 16
#: Ids of a run up to which all its pairs are compared at once; larger groups go by hubs.
SMALL = 24
#: Copies of one line above which only its first occurrence lists runs; at most 1 / HEAVY of all lines.
HEAVY = 1000
#: Lines or pairs (two longs each) that may be sent to every executor; above, the join is dealt out.
BROADCAST_ROWS = 1_000_000


def _words(line: Column) -> Column:
    """Runs of ASCII letters, digits and all characters beyond ASCII, after lower-casing."""
    return F.array_remove(F.split(F.lower(line), r"[\x00-/:-`{-\x7f]+"), F.lit(""))


def _once(c: Column) -> Column:
    """c as a generator of one row, so that what refers to it doesn't compute it again."""
    return F.explode(F.array(c))


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_k (the key), _t (a hash of the text) and _x (the text); no other column can clash."""
    return docs.select(F.col(key).alias("_k"), F.xxhash64(text).alias("_t"), F.col(text).alias("_x"))


def _edits(n: str) -> str:
    """SQL: the edits that similar lines may be apart, of which the longer has n words."""
    return f"cast(floor(({n}) * {1 - SIMILARITY:.6f} + 1e-9) as int)"


def _listed(n: str) -> str:
    """SQL: the pairs that a line of n words lists, one more than a similar line may lack.

    An edit breaks two pairs at most. Where the other line has x words more, at least x edits are
    insertions, which break one: 2 edits(n + x) - x, and that is greatest for x = 0 or 1.
    """
    return f"1 + greatest(2 * {_edits(n)}, 2 * {_edits(f'{n} + 1')} - 1)"


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_k, _t, pos, id, chk (hashes of the words), n (words), pairs and runs (that it lists, runs with some
    in reserve), m0 and m1 (parity bitmaps of the words) of every line with a word; a text without one has
    one row with a null id, and of each text exactly one row has position 0 or none."""
    lines = _texts(docs, key, text).select("_k", "_t", F.posexplode_outer(F.split("_x", "\n", -1)).alias("pos", "line"))
    lines = lines.select("_k", "_t", "pos", _once(_words(F.col("line"))).alias("w")).where("size(w) > 0 or pos is null or pos = 0")
    some = F.size("w") > 0
    order = f"if(length(x) < {COMMON_CHARS}, shiftrightunsigned(xxhash64(x), 1), xxhash64(x) | shiftleft(1L, 63))"
    base = lines.select("_k", "_t", "pos", F.when(some, F.xxhash64("w")).alias("id"), F.when(some, F.hash("w")).alias("chk"), F.size("w").alias("n"), F.expr(f"transform(w, x -> {order})").alias("h"))
    # steps of their own and no lambda over all runs, so that all but short lines' pairs is compiled code
    base = base.select("*", F.expr(f"slice(sort_array(array_distinct(h)), 1, {ANCHORS + SPARE})").alias("first"))
    pairs = "zip_with(slice(h, 1, n - 1), slice(h, 2, n - 1), (x, y) -> xxhash64(2, x, y))"
    pairs = f"if(n <= {SHORT}, slice(sort_array(array_distinct({pairs})), 1, {_listed('n')}), cast(array() as array<bigint>))"
    runs = ", ".join(f"xxhash64({RUN}, slice(h, cast(array_position(h, get(first, {i})) as int), {RUN}))" for i in range(ANCHORS + SPARE))
    runs = f"if(n >= {BOTH}, slice(array({runs}), 1, size(first)), cast(array() as array<bigint>))"
    # the lowest bit of a word's hash is its bitmap, the six bits below the highest are its place there
    bits = [f"aggregate(h, 0L, (a, x) -> a ^ shiftleft({side} & 1L, cast(shiftrightunsigned(x, 57) & 63L as int)))" for side in ("x", "~x")]
    made = [F.expr(f"if(n >= {MIN_WORDS}, {x}, null)").alias(name) for name, x in (("pairs", pairs), ("runs", runs), ("m0", bits[0]), ("m1", bits[1]))]
    return base.select("_k", "_t", "pos", "id", "chk", "n", *made)


def _common_runs(lines: DataFrame) -> str | None:
    """SQL: whether a run x is in a bucket that stands out, by counts over the runs of all lines."""
    bucket = F.col("x").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    counts = lines.select(F.explode("runs").alias("x")).groupBy(bucket.alias("b")).agg(F.count("*").alias("c"))
    found = [(r.b, r.c) for r in counts.collect()]
    mean = sum(c for _, c in found) / BUCKETS
    marks = bytearray(b"0" * BUCKETS)
    for b, c in found:
        if c > mean + max(8 * math.sqrt(mean), 32):
            marks[b] = ord("1")
    if b"1" not in marks:
        return None
    return f"substring(cast('{marks.decode()}' as binary), cast(x & {BUCKETS - 1} as int) + 1, 1) = X'31'"


#: SQL: the number of the character that stands for a word's hash x.
CODE = "cast(pmod(x, 983040) as int)"
#: SQL: 16 bits for place i (from 0) of sorted hashes s, x the one there: they tell its occurrences apart.
PART = "cast(pmod(xxhash64(x, i + 1 - array_position(s, x)), 65536) - 32768 as smallint)"


def _codes(places: str) -> str:
    """SQL: a string with one character for each of the numbers (below 983040)."""
    return f"decode(unhex(array_join(transform({places}, x -> concat('000', hex(65536 + x))), '')), 'UTF-32')"


def _exact(h: str) -> str:
    """SQL: a character for each word of h, by its place among the words of the pair (both)."""
    return _codes(f"transform({h}, x -> array_position(both, x) % 983040)")


def _place() -> Column:
    """A hash of the place of a line."""
    return F.xxhash64("_k", "_t", "pos")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """df, to be sent to every executor if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _near_pairs(small: DataFrame, meet: str) -> DataFrame:
    """The pairs (a, b) within each key that meet allows; of the other member, columns end in 2."""
    columns = [c for c in small.columns if c != "key"]
    lists = small.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias("all"))
    both = lists.select(F.explode("all").alias("x"), "all").select("x.*", F.explode("all").alias("y"))
    both = both.select(*columns, *[F.col("y")[c].alias(f"{c}2") for c in columns]).where("id < id2 and n <= cap2 and n2 <= cap").where(meet)
    return both.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def _partners() -> list[Column]:
    """Whom each member of a large group is checked against at first.

    Lines that hold one passage are nearest to the one with the least else; where a class has very many
    links to another, a few members in any order will show one.
    """
    chance = [F.xxhash64(F.lit(str(i)), "id") for i in range(2)]
    return [hub(F.col("cap")), hub(F.struct(-F.col("n"), "id")), before(F.struct("n", "id")), *map(before, chance)]


def classes(lines: DataFrame, first: DataFrame, docs: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    """id, comp of the lines with a fuzzy link. lines as `lines_of` gives them, first: a row for each id."""
    long_ = lines.where("pairs is not null")
    heavy = first.where(F.col("c") > F.greatest(F.lit(HEAVY), F.col("total") / F.lit(HEAVY))).select("id", "chk", F.col("p").alias("_p0"))
    long_ = long_.join(F.broadcast(heavy), ["id", "chk"], "left").where(F.col("_p0").isNull() | (F.col("_p0") == _place()))
    common = _common_runs(lines)
    runs = "runs" if common is None else f"concat(filter(runs, x -> not ({common})), filter(runs, x -> {common}))"
    members = long_.select("id", "n", F.explode(F.concat("pairs", F.expr(f"slice({runs}, 1, {ANCHORS})"))).alias("key"))
    held = shared(members, F.floor(F.col("n") / SIMILARITY + 1e-9)).withColumn("ids", F.count("*").over(Window.partitionBy("key")))
    marks = first.where("m0 is not null").select("id", F.col("m0").alias("mark"), "m1").dropDuplicates(["id"])
    held = scratch.put("shared", held.join(marks, "id"))

    most = _edits("greatest(a_n, b_n)")
    bits = f"2 * {_edits('greatest({0}, {1})')}"
    both_marks = f"bit_count(mark ^ mark2) + bit_count(m1 ^ m12) <= {bits.format('n', 'n2')}"
    pairs = scratch.put("pairs", _near_pairs(held.where(f"ids <= {SMALL}").drop("ids"), both_marks))
    large = scratch.put("large", held.where(f"ids > {SMALL}").drop("ids"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(large.select("id")).distinct()
    own = scratch.put("own", _word_lists(ids, first, docs, key, text, scratch))

    def sides(pairs: DataFrame, *columns: str) -> DataFrame:
        """The written pairs with these columns of both lines; of the lines only those needed are dealt out."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        needed = own.join(_sent(ids, pairs.count()), "id", "left_semi")
        for k in "ab":
            pairs = pairs.join(needed.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in columns]), k)
        return pairs

    def check(pairs: DataFrame) -> DataFrame:
        # characters by a part of the hash: equal ones for different words can only bring lines closer
        near = sides(scratch.put("asked", pairs), "code", "n")
        near = near.where(F.expr(f"abs(a_n - b_n) <= {most} and levenshtein(a_code, b_code, {most}) >= 0")).select("a", "b")
        # bound as a lambda's variable, the words of both are listed once and not for each word; where no
        # two of these have one character, the distance is right already
        both = sides(scratch.put("close", near), "h", "n")
        single = f"size(both) = size(array_distinct(transform(both, x -> {CODE})))"
        apart = f"if({single}, 0, levenshtein({_exact('a_h')}, {_exact('b_h')}, {most}))"
        return both.where(F.expr(f"transform(array(array_distinct(concat(a_h, b_h))), both -> {apart})[0] >= 0")).select("a", "b")

    def finish(named: DataFrame) -> DataFrame:
        # an edit takes at most one word from either line; on long lines bitmaps are too full to tell
        lacks = f"greatest(size(words), size(words2)) - size(array_intersect(words, words2)) <= {_edits('greatest(n, n2)')}"
        named = named.join(own.select("id", "words"), "id")
        return check(pairs_across(named, bits, f"{both_marks} and {lacks}"))

    comps = scratch.put("comps", components(check(pairs), scratch))
    return link_groups(large, check, finish, scratch, bits, comps, [_partners()])


def _word_lists(ids: DataFrame, first: DataFrame, docs: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    """id, n, h (hashes of the words), code (a character for each word) and words (16 bits for each
    occurrence of a word, once) of these lines, from a place of each."""
    places = scratch.put("places", first.join(ids, "id", "left_semi").select("id", F.col("p").alias("_p")))
    own = _texts(docs, key, text).select("_k", "_t", F.posexplode(F.split("_x", "\n", -1)).alias("pos", "line"))
    own = own.withColumn("_p", _place()).join(_sent(places, places.count()), "_p").select("id", "line").dropDuplicates(["id"])
    own = own.select("id", _once(_words(F.col("line"))).alias("w")).select("id", _once(F.transform("w", lambda x: F.xxhash64(x))).alias("h"))
    words = f"transform(array(sort_array(h)), s -> array_distinct(transform(s, (x, i) -> {PART})))[0]"
    return own.select("id", F.size("h").alias("n"), "h", F.expr(_codes(f"transform(h, x -> {CODE})")).alias("code"), F.expr(words).alias("words"))


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_k, _t, n_lines (with a word) and removed (positions of lines to drop, ascending) of each text."""
    scratch = Scratch(docs.sparkSession)
    lines = scratch.put("lines", lines_of(docs, key, text))
    held = lines.where("id is not null")
    # numbers only, so that it is summed up by hash; m0 and m1 are the same for all copies
    first = held.groupBy("id", "chk").agg(F.count("*").alias("c"), F.min(_place()).alias("p"), F.min("m0").alias("m0"), F.min("m1").alias("m1"))
    total = lines.groupBy().agg(F.count("*").alias("total"))
    first = scratch.put("first", first.join(F.broadcast(total)))
    comps = classes(lines, first, docs, key, text, Scratch(docs.sparkSession))
    # only classes with two occurrences or more lose any
    cls = F.struct(F.coalesce("comp", "id").alias("cls"), F.when(F.col("comp").isNull(), F.col("chk")).alias("chk"))
    named = first.join(comps, "id", "left").where("comp is not null or c > 1").select("id", "chk", cls.alias("cls"))
    found = scratch.put("found", held.select("_k", "_t", "pos", "id", "chk").join(named, ["id", "chk"]).select("_k", "_t", "pos", "cls"))
    # a null key comes first
    at = F.struct(F.col("_k").isNotNull().alias("known"), F.struct("_k", "_t", "pos").alias("at"))
    kept = found.groupBy("cls").agg(F.min(at)["at"].alias("kept"))
    gone = found.join(kept, "cls").where(F.struct("_k", "_t", "pos") != F.col("kept"))
    gone = gone.groupBy("_k", "_t").agg(F.sort_array(F.collect_set("pos")).alias("removed"))
    # rows equal in key and text have the same lines and one row each that starts the text
    counts = lines.groupBy("_k", "_t").agg(F.expr("count(id) div count_if(coalesce(pos, 0) = 0)").alias("n_lines"))
    own = gone.select(F.col("_k").alias("_k2"), F.col("_t").alias("_t2"), "removed")
    out = counts.join(own, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_t") == F.col("_t2")), "left")
    out = out.select("_k", "_t", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    out = Scratch(docs.sparkSession).put("removals", out)
    scratch.drop_all()
    return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text of the lines that stay; rows that lose all their lines go, rows that had
    none (no word at all) stay as they are."""
    gone = removals(docs, key, text).where(F.size("removed") > 0)
    gone = gone.select(F.col("_k").alias("_gone_k"), F.col("_t").alias("_gone_t"), "n_lines", "removed")
    out = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(key).alias("_own_k"), F.col(text).alias("_own_x"), F.xxhash64(text).alias("_own_t"))
    out = out.join(gone, F.col("_own_k").eqNullSafe(F.col("_gone_k")) & (F.col("_own_t") == F.col("_gone_t")), "left")
    out = out.where(F.col("removed").isNull() | (F.size("removed") < F.col("n_lines")))
    kept = F.expr("array_join(filter(split(_own_x, '\\n', -1), (x, i) -> not array_contains(removed, i)), '\\n')")
    new = F.when(F.col("removed").isNull(), F.col("_own_x")).otherwise(kept)
    return out.select(*[new.alias(c) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns])
