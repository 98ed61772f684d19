"""URL filters: longest-match host and path rules, and a Bloom filter cascade of listed hosts.

`Cascade` answers, without a join, whether a key of a known universe is listed, and never errs on
that universe: level 1 is a Bloom filter of the listed keys; level 2 one of the other keys that
level 1 lets through; level 3 one of the listed keys that level 2 lets through, and so on until no
key errs. A key is listed if the first level that turns it down has an even number (from 1), or if
all do not and the last has an odd one. Keys are split by hash into shards of at most
`SHARD_KEYS` listed keys, and each shard has its own levels, so a filter's size is bounded; the
bits travel with the tasks. Shards are answered in groups of at most `INLINE_BYTES`; a larger list
takes one pass over the rows for each group.

Nulls: a null url, or one without ://, has empty host and path, fits no rule and is not listed.
Empty tables give empty results. Repeated urls are judged alike.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import Scratch, ascii_lower

BITS_PER_KEY, HASHES = 8, 3
SHARD_KEYS = 1_000_000
INLINE_BYTES = 32 << 20


def host(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or the end, A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest of the rules (verdict, host, path) that fits, else null.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rh, rp in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # later, so longer, ones win
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        out = F.when(fits, F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _positions(hashed: Column, level: int, bits: int) -> Column:
    """The HASHES bit positions of a key at a level."""
    return F.array(*[F.pmod(F.xxhash64(hashed, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(HASHES)])


@dataclass
class Cascade:
    """levels[shard][i] = (bits, packed words) of level i + 1."""

    shards: int
    levels: list[list[tuple[int, bytes]]]
    seed: int = 0

    @classmethod
    def build(cls, universe: DataFrame, key: str, listed: str) -> Cascade:
        """universe: one row a key, with a boolean column that says whether it is listed.

        Each level is one aggregation of (shard, word of bits) and one filter of the keys that err. Levels
        end when no key errs, however many that takes. Keys are told apart by a 64-bit hash; if a listed
        and another key have the same, all are hashed anew with the next seed.
        """
        seed = -1
        scratch = Scratch(universe.sparkSession)
        while True:
            seed += 1
            keys = scratch.put("keys", universe.select(F.xxhash64(F.lit(seed), key).alias("k"), F.col(listed).alias("on")).distinct())
            if keys.groupBy("k").count().where("count > 1").isEmpty():
                break
        shards = max(1, -(-keys.where("on").count() // SHARD_KEYS))
        keys = keys.withColumn("shard", F.pmod(F.col("k"), F.lit(shards)).cast("int"))
        levels: list[list[tuple[int, bytes]]] = [[] for _ in range(shards)]
        into, other = keys.where("on"), keys.where("not on")
        for level in itertools.count(1):
            sizes = {r.shard: r.n for r in into.groupBy("shard").agg(F.count("*").alias("n")).collect()}
            if not sizes:
                break
            # a level's bits depend on its largest shard, so that one expression serves all
            bits = 64 * (-(-BITS_PER_KEY * max(sizes.values()) // 64) + level % 3)
            words = into.select("shard", F.explode(_positions(F.col("k"), level, bits)).alias("p"))
            words = words.groupBy("shard", F.floor(F.col("p") / 64).alias("w")).agg(
                F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")
            )
            packed = {s: np.zeros(bits // 64, np.int64) for s in range(shards)}
            for r in words.toLocalIterator():
                packed[r.shard][r.w] = r.b
            for s in range(shards):
                levels[s].append((bits, packed[s].tobytes()))
            now = cls(shards, [[lv[-1]] for lv in levels], seed)
            passed = other.where(now._passes(level)("k", "shard"))
            # of the other kind, those that err must be told apart at the next level
            into, other = scratch.put(f"kind{level % 2}", passed), into
        scratch.drop_all()
        return cls(shards, levels, seed)

    def _passes(self, first: int):
        """A UDF: whether a key passes the only level there is, which has number `first`."""
        levels = self.levels

        @F.pandas_udf(BooleanType())
        def passes(pos: pd.Series, shard: pd.Series) -> pd.Series:
            return pd.Series(_test(levels, 0, np.stack(pos.to_numpy()) if len(pos) else np.zeros((0, HASHES), np.int64), shard.to_numpy()))

        bits = levels[0][0][0]
        return lambda k, shard: passes(_positions(F.col(k), first, bits), F.col(shard))

    def groups(self) -> list[range]:
        """Runs of shards whose bits stay under INLINE_BYTES (one shard at least)."""
        out, used = [], INLINE_BYTES + 1
        for s in range(self.shards):
            own = sum(len(b) for _, b in self.levels[s])
            if used + own > INLINE_BYTES:
                out.append(range(s, s))
                used = 0
            out[-1], used = range(out[-1].start, s + 1), used + own
        return out

    def mark(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """df with a boolean column: whether the key, one of the universe, is listed; null is not."""
        if not self.levels or not self.levels[0]:
            return df.withColumn(name, F.lit(False))
        df = df.withColumn("_u_k", F.xxhash64(F.lit(self.seed), key)).withColumn("_u_s", F.pmod("_u_k", F.lit(self.shards)).cast("int"))
        places = F.array(*[_positions(F.col("_u_k"), i + 1, lv[0]) for i, lv in enumerate(self.levels[0])])
        out = None
        for g in self.groups():
            one = df if len(self.groups()) == 1 else df.where(F.col("_u_s").between(g.start, g.stop - 1))
            held = {s: self.levels[s] for s in g}
            one = one.withColumn(name, _member(held)(places, "_u_s") & F.col(key).isNotNull())
            out = one if out is None else out.unionByName(one)
        return out.drop("_u_k", "_u_s")


def _member(levels: dict):
    n = len(next(iter(levels.values())))

    @F.pandas_udf(BooleanType())
    def member(pos: pd.Series, shard: pd.Series) -> pd.Series:
        shards = shard.to_numpy()
        out, open_ = np.zeros(len(pos), bool), np.ones(len(pos), bool)
        for i in range(n):
            hit = _test(levels, i, np.array([p[i] for p in pos], dtype=np.int64).reshape(-1, HASHES), shards)
            out[open_ & ~hit] = i % 2 == 1
            open_ &= hit
        out[open_] = n % 2 == 1
        return pd.Series(out)

    return member


def _test(levels, i: int, pos: np.ndarray, shards: np.ndarray) -> np.ndarray:
    """Which rows have all their bits set in level i of their shard."""
    out = np.zeros(len(pos), bool)
    for s in np.unique(shards):
        words = np.frombuffer(levels[s][i][1], np.int64)
        mine = np.flatnonzero(shards == s)
        p = pos[mine]
        out[mine] = ((words[p >> 6] >> (p & 63)) & 1).all(axis=1) if len(words) else False
    return out


def judge(pages: DataFrame, rules: list, listed: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, url, host, path, rule, verdict of every page: the rule's verdict, else block for listed hosts.

    listed: any table with a column host; rows may repeat. The universe of the cascade is every host of
    the pages, so hosts of the list that no page has take no room. Other columns are not read.
    """
    parts = pages.select(key, url, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    on = listed.select("host").distinct().withColumn("on", F.lit(True))
    universe = parts.select("host").distinct().join(on, "host", "left").select("host", F.coalesce("on", F.lit(False)).alias("on"))
    cascade = Cascade.build(universe, "host", "on")
    found = rule_of(F.col("host"), F.col("path"), rules)
    out = cascade.mark(parts.withColumn("_u_r", found), "host", "_u_l")
    return out.select(
        key, url, "host", "path", F.col("_u_r.rule").alias("rule"),
        F.coalesce(F.col("_u_r.verdict"), F.when(F.col("_u_l"), "block").otherwise("allow")).alias("verdict"),
    )
