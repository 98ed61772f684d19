"""Best-fit packing of token sequences by vectors of residual capacity.

`pieces` tokenizes whole texts and cuts only those longer than a sequence. `pack` puts pieces into
bins under three capacities at once: tokens, documents and attention cost (the sum of squared piece
lengths, as attention is kept inside each piece). Pieces are taken by falling length; each goes to
the open bin, among those that can hold it in every dimension, whose weighted residual norm after
placing is least, and to a new bin if there is none. Full-length pieces take a bin each.

Pieces are dealt by hash to groups of about `GROUP_PIECES`; a second round packs again, in larger
units, what lies in bins filled below `REOPEN`, so that few groups leave gaps at their end. A group
is held by one task; its size is bounded by the number of groups, which follows the count.

Nulls: a null text counts as empty (one end token); a null key is kept. Empty tables give empty
results. Repeated rows are packed each on its own.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialize

SEQ_TOKENS = 2048
GROUP_PIECES = 20_000
REOPEN = 0.97
#: Weights of the residual norm: tokens, documents, attention cost (each relative to its capacity).
WEIGHTS = (1.0, 0.05, 0.1)
#: Words kept with their ids in a worker's cache, and the longest word that is kept.
CACHE_WORDS, CACHE_LENGTH = 700_000, 48


class _Ids(dict):
    """Ids of words as little-endian 32-bit bytes, looked up once a worker; a bounded cache.

    The tokenizer's pattern never joins what blanks part, so a text's ids are its words' ids in turn.
    Nor does it join letters with ASCII marks or digits, apostrophes apart, so a new word is read as
    its runs of each, which are fewer than the words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.runs: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        plain = b"'" not in word and b"<|" not in word and (word.isascii() or all(c.isalpha() for c in word.decode() if c > "\x7f"))
        found = b"".join(map(self._run, RUNS.findall(word))) if plain else self._encode(word)
        return _keep(self, word, found)

    def _run(self, run: bytes) -> bytes:
        found = self.runs.get(run)
        if found is None:
            found = _keep(self.runs, run, self._apart(run))
        return found

    def _apart(self, run: bytes) -> bytes:
        """The model's ids of a run that the normalizer leaves as it is; else by the whole tokenizer."""
        if run.isdigit():
            return b"".join(map(self._model, run.decode()))  # digits stand alone
        text = run.decode()
        if run.isascii():
            same = text.isprintable() and run == run.lower()
        else:
            same = unicodedata.is_normalized("NFC", text) and all(c == c.lower() for c in text)
            text = run.decode("latin-1").translate(BYTE_CHARS)
        return self._model(text) if same else self._encode(run)

    def _model(self, text: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _encode(self, part: bytes) -> bytes:
        return array("I", self.tokenizer.encode(part.decode(), add_special_tokens=False).ids).tobytes()


#: Bytes as a byte-level vocabulary spells them: printable Latin-1 as it is, the others in turn from 256.
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
RUNS = re.compile(rb"[a-zA-Z\x80-\xff]+|[0-9]+|[^a-zA-Z0-9\x80-\xff]+")


def _keep(cache: dict, word: bytes, found: bytes) -> bytes:
    if len(word) <= CACHE_LENGTH:
        if len(cache) >= CACHE_WORDS:
            cache.clear()
        cache[word] = found
    return found


@functools.lru_cache(maxsize=1)
def _ids(path: str) -> _Ids:
    return _Ids(path)


def _lowered(text: bytes) -> bytes:
    """A-Z lower-cased, as the tokenizer does, unless a combining mark might join with a letter first."""
    return text if b"\xcc" in text or b"\xcd" in text else text.lower()


def pieces(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, seq: int = SEQ_TOKENS, with_ids: bool = False
) -> DataFrame:
    """key, piece int, start long, length long, ids_crc32 long and, if asked for, ids (little-endian
    32-bit) of every piece. A document is its text's ids and then end_id."""
    fields = "piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    schema = StructType([StructField(key, docs.schema[key].dataType), *StructType.fromDDL(fields)])
    arrow = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
    arrow = arrow if with_ids else arrow[:-1]
    end, step = np.array([end_id], "<u4").tobytes(), 4 * seq

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(tokenizer)
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1)):
                words = _lowered((t.as_py() or "").encode()).split()
                whole = b"".join(map(ids.__getitem__, words)) + end
                for k in range(0, len(whole), step):
                    part = whole[k : k + step]
                    at.append(i)
                    rows.append((k // step, k // 4, len(part) // 4, zlib.crc32(part), part)[: len(arrow)])
            cols = list(zip(*rows)) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, (_, t) in zip(cols, arrow)]],
                names=[key, *[n for n, _ in arrow]],
            )

    return docs.select(key, text).mapInArrow(run, schema)


def _best_fit(lengths: np.ndarray, docs: np.ndarray, costs: np.ndarray, caps: tuple[int, int, int]) -> np.ndarray:
    """The bin of each unit; units are placed in the order given (by falling length)."""
    n = len(lengths)
    bins = np.zeros(n, np.int64)
    # residual capacities of open bins, compacted as bins fill up
    rt, rd, rc, ident = (np.empty(1024, np.int64) for _ in range(4))
    size = made = 0
    least = lengths.min() if n else 0
    wt, wd, wc = WEIGHTS
    for i in range(n):
        length, d, c = int(lengths[i]), int(docs[i]), int(costs[i])
        j = -1
        if size:
            t, e, f = rt[:size] - length, rd[:size] - d, rc[:size] - c
            ok = (t >= 0) & (e >= 0) & (f >= 0)
            if ok.any():
                norm = wt * (t / caps[0]) ** 2 + wd * (e / caps[1]) ** 2 + wc * (f / caps[2]) ** 2
                j = int(np.argmin(np.where(ok, norm, np.inf)))
        if j < 0:
            if size == len(rt):
                rt, rd, rc, ident = (np.concatenate([a, np.empty_like(a)]) for a in (rt, rd, rc, ident))
            j = size
            rt[j], rd[j], rc[j], ident[j] = *caps, made
            size, made = size + 1, made + 1
        rt[j], rd[j], rc[j] = rt[j] - length, rd[j] - d, rc[j] - c
        bins[i] = ident[j]
        if rt[j] < least or rd[j] < 1:  # nothing fits any more
            size -= 1
            for a in (rt, rd, rc, ident):
                a[j] = a[size]
    return bins


def _round(items: DataFrame, groups: int, first: int, caps: tuple[int, int, int]) -> DataFrame:
    """Packs units (the rows of one `_b_unit`) anew within hash groups; sets _b_seq."""
    out = StructType([f for f in items.schema if f.name not in ("_b_seq", "_b_g")] + [StructField("_b_seq", LongType())])
    names = out.fieldNames()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = pdf.assign(_d=1, _c=pdf["length"] ** 2).groupby("_b_unit").agg(length=("length", "sum"), d=("_d", "sum"), c=("_c", "sum"))
        sums = sums.reset_index().sort_values(["length", "_b_unit"], ascending=[False, True], kind="stable")
        bins = _best_fit(sums["length"].to_numpy(), sums["d"].to_numpy(), sums["c"].to_numpy(), caps)
        group = int(pdf["_b_g"].iloc[0])
        place = pd.Series((np.int64(first + group) << 32) + bins, index=sums["_b_unit"].to_numpy())
        return pdf.assign(_b_seq=pdf["_b_unit"].map(place).astype("int64"))[names]

    dealt = items.withColumn("_b_g", F.pmod(F.xxhash64("_b_unit"), F.lit(groups)).cast("int"))
    return dealt.groupBy("_b_g").applyInPandas(run, out)


def pack(
    items: DataFrame, key: str = "doc_id", seq: int = SEQ_TOKENS, max_docs: int | None = None, max_cost: int | None = None,
    group: int = GROUP_PIECES,
) -> DataFrame:
    """items (key, piece, start, length, ...) with sequence_id and offset long, gapless from 0.

    max_docs and max_cost default to seq and seq squared, which no sequence exceeds.
    """
    caps = (seq, max_docs or seq, max_cost or seq * seq)
    # the written table fixes each row's number, so a task that runs again finds the same ones
    held = materialize(items.withColumn("_b_row", F.monotonically_increasing_id()))
    one = held.withColumn("_b_unit", F.col("_b_row"))
    n = one.where(F.col("length") < seq).count()
    full = one.where(F.col("length") >= seq).withColumn("_b_seq", F.col("_b_row") + F.lit(1 << 62))
    groups = max(1, -(-n // group))
    packed = _round(one.where(F.col("length") < seq), groups, 0, caps)
    if groups > 1:
        packed = materialize(packed)
        fill = packed.groupBy("_b_seq").agg(F.sum("length").alias("_b_fill")).where(F.col("_b_fill") < REOPEN * seq)
        loose = packed.join(fill.select("_b_seq"), "_b_seq", "left_semi").withColumn("_b_unit", F.col("_b_row"))
        loose = materialize(loose)
        again = _round(loose, max(1, -(-loose.count() // group)), groups, caps)
        packed = packed.join(fill.select("_b_seq"), "_b_seq", "left_anti").unionByName(again)
    packed = packed.unionByName(full)
    in_order = Window.partitionBy("_b_seq").orderBy(F.col("length").desc(), "_b_row").rowsBetween(Window.unboundedPreceding, -1)
    out = packed.withColumn("offset", F.coalesce(F.sum("length").over(in_order), F.lit(0)).cast("long"))
    return out.withColumnRenamed("_b_seq", "sequence_id").drop("_b_unit", "_b_row")
