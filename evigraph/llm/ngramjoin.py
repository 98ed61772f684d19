"""N-gram Jaccard join by prefix trees: which texts share three quarters of their 5-word shingles.

A text's set holds the 64-bit hashes of its distinct shingles; texts with the same set are one node.
Candidates: all sets are ordered alike, by hash, but shingles that many texts share come last. Two sets
that link share an entry among the first n - ceil(3n/4) + 1 of each, as past that depth what remains of
a path is too short for the overlap that is needed. Each set is listed at these entries, and only sets
that meet at an entry are compared (see `grouplinks` for entries where very many meet). A pair goes on
if the sizes and the parity bitmaps of the two sets allow a link (upper bounds, so no link is lost).

Decision: the sets to be compared with one set are stored in a trie by the order of their entries, with
paths that branch nowhere kept as one edge. One walk carries the partial overlap along each path, so
sets with a common beginning share its count, and a branch is left as soon as the overlap so far and
the remaining length together can't reach what is needed. A set with many partners has its tries in
blocks, each in a task of its own, so no task holds more than a block.

Nulls: a null or empty text has no shingle and links with nothing; a null id is kept, and names no
class. A text with fewer words than a shingle has one shingle, its whole sequence. Empty tables give
empty results. Repeated rows are one node and each gets a row of the result; a class is named by its
smallest id, whatever the ties. Other columns are not read, so their names can't clash. Texts of any
length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .grouplinks import link_groups, pairs_across, shared

SHINGLE = 5
#: A link has NUM / DEN of the union in common.
NUM, DEN = 3, 4
#: Shingles found so often in one batch of rows (or in this share of it) count as shared by many;
#: they change the order of the sets and so the work, never the result. At most so many are kept.
HOT_COUNT, HOT_SHARE, HOT_MAX = 2, 4000, 400_000
#: Sets in one trie.
BLOCK = 512
#: Rows of ids that may be sent to every executor; above, the join is dealt by key.
BROADCAST_ROWS = 1_000_000

_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as the longest text so far needs."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            grow = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(self.n - 1, x, np.uint64)]))
            self.up, self.down = grow(self.BASE), grow(pow(self.BASE, -1, 1 << 64))
        return self.up[:n], self.down[:n]


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingle_set(text: str | None, powers: _Powers) -> np.ndarray:
    """The sorted distinct shingle hashes of a text (A-Z lower-cased, words parted by ASCII blanks).

    A word's hash is the sum of its bytes' values times powers of their places in it, got for all
    words at once from running sums over the text.
    """
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    if not n:
        return np.empty(0, np.uint64)
    up, down = powers.upto(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up, out=sums[1:])
    h = _mix((sums[ends] - sums[starts]) * down[starts])
    if n < SHINGLE:
        return _mix(np.array([(h * _C[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    total = h[: n - SHINGLE + 1] * _C[0]
    for k in range(1, SHINGLE):
        total += h[k : n - SHINGLE + 1 + k] * _C[k]
    total = _mix(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def _name(s: np.ndarray) -> int:
    """The node of a set: a hash of its entries."""
    return xxhash.xxh64_intdigest(s.tobytes(), seed=len(s)) if len(s) else 0


def _signed(xs) -> np.ndarray:
    return np.asarray(xs, np.uint64).view(np.int64)


def _parity(s: np.ndarray) -> list[int]:
    """Parity bits of the entries' low bits in 64-bit words; twice as many bits as entries, or so."""
    bits = 512
    while bits < 2 * len(s) and bits < 1 << 17:
        bits *= 2
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _sets(batch: pa.RecordBatch, powers: _Powers) -> list[np.ndarray]:
    return [shingle_set(t.as_py(), powers) for t in batch.column(1)]


#: Rows whose sets a task holds at once; bounds its memory.
SLICE_ROWS = 1500


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def nodes_and_hot(docs: DataFrame, key: str, text: str, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """(id, n, node, parity) of every row, written once, and the sorted shingles that many texts share."""
    fields = {"hot": pa.bool_(), "id": pa.int64(), "n": pa.int64(), "node": pa.int64(), "parity": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            own: list[np.ndarray] = []
            done: set[int] = set()
            for part in _slices(iter([batch])):
                sets = _sets(part, powers)
                names = [_name(x) for x in sets]
                seen = dict(zip(names, sets))
                parity = {k: _parity(x) for k, x in seen.items()}
                own.append(np.concatenate([*(x for k, x in seen.items() if k not in done), np.empty(0, np.uint64)]))
                done.update(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([False] * len(sets), pa.bool_()), part.column(0).cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(_signed(names)), pa.array([parity[k] for k in names], fields["parity"])],
                    names=list(fields),
                )
            everything = np.concatenate(own)
            del own
            everything.sort()
            ends = np.flatnonzero(np.concatenate([everything[1:] != everything[:-1], [True] * (len(everything) > 0)]))
            counts = np.diff(ends, prepend=-1)
            many = counts >= max(HOT_COUNT, batch.num_rows / HOT_SHARE)
            found, counts = everything[ends[many]], counts[many]
            yield pa.RecordBatch.from_arrays(
                [pa.array([True] * len(found), pa.bool_()), pa.array(_signed(found)), pa.array(counts), pa.nulls(len(found), pa.int64()), pa.nulls(len(found), fields["parity"])],
                names=list(fields),
            )

    rows = scratch.put("rows", docs.select(key, text).mapInArrow(run, "hot boolean, id bigint, n bigint, node bigint, parity array<bigint>"))
    hot = rows.where("hot").groupBy("id").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "id").limit(HOT_MAX)
    found = np.sort(np.array([r.id for r in hot.select("id").toLocalIterator()], np.int64).view(np.uint64))
    return rows.where("not hot").drop("hot"), found


def branches(docs: DataFrame, key: str, text: str, hot: np.ndarray) -> DataFrame:
    """key (entry), id (node), n (entries), at (place on the path): each distinct set of a task at the
    entries where it may first meet another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, done = _Powers(), set()
        for batch in _slices(batches):
            seen = {_name(s): s for s in _sets(batch, powers) if len(s)}
            seen = {k: s for k, s in seen.items() if k not in done}
            done.update(seen)
            keys, ids, sizes, places = [], [], [], []
            for name, s in seen.items():
                depth = len(s) - -(-NUM * len(s) // DEN) + 1
                if len(hot):
                    common = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
                    rare = s[~common]
                    path = rare[:depth] if len(rare) >= depth else np.concatenate([rare, s[common][: depth - len(rare)]])
                else:
                    path = s[:depth]
                keys.append(path)
                ids.append(np.full(len(path), name, np.uint64))
                sizes.append(np.full(len(path), len(s), np.int32))
                places.append(np.arange(len(path), dtype=np.int32))
            whole = lambda x, kind: np.concatenate(x or [np.empty(0, kind)])
            columns = [whole(keys, np.uint64).view(np.int64), whole(ids, np.uint64).view(np.int64), whole(sizes, np.int32), whole(places, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "n", "at"])

    return docs.select(key, text).mapInArrow(run, "key bigint, id bigint, n int, at int")


def whole_sets(docs: DataFrame, key: str, text: str, needed: DataFrame) -> DataFrame:
    """node, entries of the nodes in `needed` (node, and one row id that has it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in _slices(batches):
            seen = {_name(s): s for s in _sets(batch, powers)}
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(list(seen))), pa.array([s.view(np.int64) for s in seen.values()], pa.list_(pa.int64()))], names=["node", "entries"]
            )

    ids = needed.select(F.col("id").alias("_j_id"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    own = docs.select(key, text).join(ids, F.col(key).eqNullSafe(F.col("_j_id")), "left_semi").mapInArrow(run, "node bigint, entries array<bigint>")
    return own.join(needed.select("node"), "node", "left_semi").dropDuplicates(["node"])


def links_in_trie(hub: np.ndarray, sets: list[np.ndarray]) -> list[bool]:
    """Which of the sets (sorted) link with the hub (sorted): one walk over the trie of the sets.

    The trie is kept as its paths in order, each with the depth to which it runs with the one before;
    `counts` holds the overlap at each depth of the path that was walked last.
    """
    out = [False] * len(sets)
    walked, counts = np.empty(0, np.int64), np.zeros(1, np.int64)
    for i in sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes()):
        s = sets[i]
        n = len(s)
        need = -(-NUM * (n + len(hub)) // (NUM + DEN))
        m = min(len(walked), n)
        apart = np.flatnonzero(walked[:m] != s[:m])
        depth = int(apart[0]) if len(apart) else m
        if counts[depth] + n - depth < need:
            # what remains is too short; the paths walked so far still hold up to here
            walked, counts = walked[:depth], counts[: depth + 1]
            continue
        edge = s[depth:]
        found = hub[np.minimum(np.searchsorted(hub, edge), len(hub) - 1)] == edge
        walked, counts = s, np.concatenate([counts[: depth + 1], counts[depth] + np.cumsum(found)])
        out[i] = bool(counts[n] >= need)
    return out


def verified(near: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of near that are links; sets: node, entries."""
    sizes = near.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    hubs = sizes.join(sets.withColumnRenamed("node", "a"), "a")
    hubs = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("bigint").alias("b"), "entries")
    members = near.join(sizes, "a").join(sets.withColumnRenamed("node", "b"), "b")
    members = members.select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), "b", "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hub, names, own = None, None, [], []

        def links() -> pa.RecordBatch:
            hit = [b for b, linked in zip(names, links_in_trie(hub, own)) if linked] if names else []
            return pa.RecordBatch.from_arrays([pa.array([group[0] if group else 0] * len(hit), pa.int64()), pa.array(hit, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            entries = batch.column(3)
            flat, ends = entries.values.to_numpy(zero_copy_only=False).view(np.uint64), entries.offsets.to_numpy()
            for i, (a, block, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                s = flat[ends[i] : ends[i + 1]]
                if (a, block) != group:
                    yield links()
                    group, hub, names, own = (a, block), None, [], []
                if b is None:
                    hub = s.copy()
                else:
                    names.append(b)
                    own.append(s.copy())
        yield links()

    rows = hubs.unionByName(members).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return rows.mapInArrow(run, "a bigint, b bigint")


#: SQL: the bits in which the parity bitmaps a_p and b_p differ; the longer is folded to the shorter.
_FOLD = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (x, y) -> x ^ y), {0})"


def _allowed(n1: str, n2: str, p1: str, p2: str) -> str:
    """SQL: sizes and bitmaps allow a link. |a - b| + |b - a| is at most (1 - J) / (1 + J) of both sizes."""
    bits = f"aggregate(zip_with({_FOLD.format(p1, p2)}, {_FOLD.format(p2, p1)}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return f"{DEN} * least({n1}, {n2}) >= {NUM} * greatest({n1}, {n2}) and {DEN + NUM} * {bits} <= {DEN - NUM} * ({n1} + {n2})"


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, node, cls of every row: cls names its class, and is null for empty sets."""
    spark = docs.sparkSession
    scratch, own = Scratch(spark), Scratch(spark)
    rows, hot = nodes_and_hot(docs, key, text, own)
    nodes = own.put("nodes", rows.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.min("id").alias("id"), F.first("parity").alias("parity")))

    def decided(near: DataFrame) -> DataFrame:
        near = scratch.put("near", near)
        if near.isEmpty():
            return near
        ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        needed = scratch.put("needed", nodes.select("node", "id").join(ends, "node", "left_semi"))
        return verified(near, scratch.put("sets", whole_sets(docs, key, text, needed)))

    def check(pairs: DataFrame) -> DataFrame:
        side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"{k}_n"), F.col("parity").alias(f"{k}_p"))
        return decided(pairs.join(side("a"), "a").join(side("b"), "b").where(_allowed("a_n", "b_n", "a_p", "b_p")).select("a", "b"))

    def finish(named: DataFrame) -> DataFrame:
        # members carry their bitmap folded to four longs, still an upper bound; pairs that pass meet the whole one
        folded = [F.expr(f"aggregate(filter(parity, (x, i) -> i % 4 = {k}), 0L, (a, x) -> a ^ x)").alias(f"p{k}") for k in range(4)]
        short = nodes.select(F.col("node").alias("id"), *folded)
        bits = " + ".join(f"bit_count(p{k} ^ p{k}2)" for k in range(4))
        near = f"{DEN} * least(n, n2) >= {NUM} * greatest(n, n2) and {DEN + NUM} * ({bits}) <= {DEN - NUM} * (n + n2)"
        return check(scratch.put("across", pairs_across(named.join(short, "id"), more=near)))

    # if this is the first common entry, at most what follows it is common
    cap = F.floor((NUM + DEN) * (F.col("n") - F.col("at")) / NUM).cast("long") - F.col("n")
    held = shared(branches(docs, key, text, hot), cap).select("key", "id", "n", "cap", F.lit(0).cast("long").alias("mark"))
    comps = link_groups(scratch.put("held", held), check, finish, scratch)
    named = rows.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node"))
    named = named.join(comps.withColumnRenamed("id", "node"), "node", "left")
    out = Scratch(spark).put("classes", named.select("id", "n_shingles", "node", F.coalesce("comp", "node").alias("cls")))
    scratch.drop_all()
    own.drop_all()
    return out


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the smallest id of the row's class) of every row."""
    own = classes(docs, key, text)
    least = own.where("cls is not null").groupBy("cls").agg(F.min("id").alias("least"))
    out = own.join(least, "cls", "left")
    return out.select(F.col("id").alias(key), "n_shingles", F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class, the first by key; a row with a null key stays.

    Rows are told apart by a number of their own, so a repeated key takes no other row along, and of
    identical rows one stays. The written table fixes the numbers; rows are carried whole.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*docs.columns).alias("_doc"))
    rows = Scratch(docs.sparkSession).put("numbered", numbered)
    texts = rows.select("_row", F.col("_doc")[key].alias("_own_key"), F.col("_doc")[text].alias("_own_text"))
    own = classes(texts, "_row", "_own_text").where("cls is not null").select(F.col("id").alias("_row"), "cls")
    own = own.join(texts.where("_own_key is not null").select("_row", "_own_key"), "_row")
    least = own.groupBy("cls").agg(F.min(F.struct("_own_key", "_row"))["_row"].alias("_kept"))
    gone = Scratch(docs.sparkSession).put("gone", own.join(least, "cls").where("_row <> _kept").select("_row"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return rows.join(gone, "_row", "left_anti").select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
