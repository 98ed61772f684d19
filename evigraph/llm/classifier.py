"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

`statistics` counts, over whole texts, what the model looks at; the language, source and key of a
document are no inputs. `fit` learns from labelled rows: random Fourier features approximate a
Gaussian kernel over the standardised statistics, every partition sums its part of the normal
equations, ridge regression solves them, and scores of rows that the regression has not seen are
made probabilities by isotonic regression. `score` applies the model where the texts lie.

At most `MAX_ROWS` labelled rows are learned from, those with the smallest hash of key; all statistics and
scores cover all rows. A null text is empty. A key's label is 1 if any of its label rows says 1; null
labels, keys without a document and null keys teach nothing, and repeated documents teach once
each. With labels of one class only, or none, every score is the share of label 1 (0.5 without labels). Ties
get equal scores. Columns of other names are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, count_chars, has_word, word_array

#: Most labelled rows that the model is fitted to; partitions hold PART_ROWS of them each.
MAX_ROWS, PART_ROWS = 200_000, 4_096
#: Random features, width of the kernel in standard deviations a statistic, and ridge.
FEATURES, WIDTH, RIDGE, SEED = 256, 1.5, 1.0, 11
#: One of so many rows calibrates the scores; score ranges at calibration.
CALIBRATE, BINS = 4, 400
#: A score of this or more predicts label 1.
CUTOFF = 0.3
FOLDS = 5

STATISTICS = [
    "words", "word_chars", "distinct", "again", "symbols", "pipes", "exclaimed", "capitals", "digits", "marks", "lines", "dup_lines", "longest",
]


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of a text, as columns: logarithms of sizes, and shares of words, characters or lines."""
    t = F.coalesce(text, F.lit(""))
    w = word_array(text)
    n = F.size(w)
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    chars = F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", ""))
    gone = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    lines = F.filter(F.split(t, "\n", -1), has_word)
    # equal neighbours: the words are compared with themselves, moved by one
    again = F.size(F.filter(F.zip_with(w, F.slice(w, F.lit(2), F.greatest(n, F.lit(1))), lambda a, b: a == b), lambda same: same))
    return {
        "words": F.log1p(n), "word_chars": F.log1p(share(chars, n)), "distinct": share(F.size(F.array_distinct(w)), n), "again": share(again, n),
        "symbols": share(count_chars(t, "#*$%&<>"), chars), "pipes": share(count_chars(t, "|"), chars), "exclaimed": share(count_chars(t, "!"), chars),
        "capitals": share(gone(r"\p{Lu}+"), chars), "digits": share(gone("[0-9]+"), chars), "marks": share(gone(r"[.,;:?\"'()\[\]{}/_=@-]+"), chars),
        "lines": F.log1p(F.size(lines)), "dup_lines": share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "longest": F.log1p(F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0))),
    }


@dataclass
class Model:
    """base: the score where no regression was fitted. Else scores are read off (knots, levels)."""

    base: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale) @ self.weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        raw = self.raw(x)
        return raw if self.knots is None else np.clip(np.interp(raw, self.knots, self.levels), 0, 1)


def fourier(z: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """cos(z W + b) for fixed random W and b, and a 1: inner products approximate exp(-|x - y|^2 / (2 s^2)), s = width * sqrt(dim)."""
    rng = np.random.default_rng(seed)
    w = rng.standard_normal((z.shape[1], features)) / (width * np.sqrt(z.shape[1]))
    b = rng.uniform(0, 2 * np.pi, features)
    # far outliers would turn with each rounding; beyond ten deviations all are alike
    out = np.cos(np.clip(z, -10, 10) @ w + b) * np.sqrt(2 / features)
    return np.hstack([out, np.ones((len(z), 1))])


def isotonic(x: np.ndarray, hits: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins sorted by x: the knots and rising levels of a piecewise linear map.

    Each level is shrunk by half a row of either class, so that none is 0 or 1. A map between the centres of
    levels, not steps, keeps more of the order of raw scores.
    """
    blocks: list[list[float]] = []
    for xi, h, n in zip(x, hits, rows, strict=True):
        blocks.append([xi * n, h, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    knots = np.array([s / n for s, _, n in blocks])
    levels = np.maximum.accumulate([(h + 0.5) / (n + 1) for _, h, n in blocks])
    return np.concatenate([[knots[0] - 1], knots, [knots[-1] + 1]]), np.concatenate([[levels[0] / 2], levels, [(1 + levels[-1]) / 2]])


def _matrix(df: pd.DataFrame) -> np.ndarray:
    return df[STATISTICS].to_numpy(dtype="float64")


def _solve(rows: DataFrame, model: Model) -> np.ndarray:
    """Ridge weights from normal equations: each partition gives one row of sums, of bounded number and size."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 2, FEATURES + 1))
        for df in batches:
            z = fourier((_matrix(df) - model.mean) / model.scale)
            total[:-1] += z.T @ z
            total[-1] += z.T @ (df["label"].to_numpy(dtype="float64") - model.base)
        yield pd.DataFrame({"sums": [total.reshape(-1).tolist()]})

    total = np.zeros((FEATURES + 2) * (FEATURES + 1))
    for r in rows.mapInPandas(sums, "sums array<double>").toLocalIterator():
        total += np.array(r.sums)
    total = total.reshape(FEATURES + 2, FEATURES + 1)
    penalty = np.full(FEATURES + 1, RIDGE)
    penalty[-1] = 1e-9  # the constant is free
    return np.linalg.solve(total[:-1] + np.diag(penalty), total[-1])


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """The model of labelled rows. stats: _key and STATISTICS of the rows that may be learned from."""
    scratch = Scratch(stats.sparkSession)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(key).alias("_key")).agg(F.max((F.col(label) == 1).cast("int")).alias("label"))
    hashed = F.pmod(F.xxhash64(F.lit(SEED), "_key"), F.lit(1 << 40))
    rows = scratch.put("labelled", stats.join(known, "_key").withColumn("_h", hashed).select("_h", "label", *STATISTICS))
    n = rows.count()
    if n > max_rows:
        # the share of hashes that leaves max_rows, so that the bound needs no sort
        rows = rows.where(F.col("_h") < F.lit(int((1 << 40) * (max_rows / n))))
    shape = [F.count("*").alias("n"), F.avg("label").alias("base")]
    shape += [f(c).alias(f"{k}_{c}") for c in STATISTICS for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    got = rows.agg(*shape).first()
    if not got.n or got.base in (0.0, 1.0):
        scratch.drop_all()
        return Model(got.base if got.n else 0.5)
    model = Model(got.base, np.array([got[f"m_{c}"] for c in STATISTICS]), np.array([max(got[f"s_{c}"], 1e-6) for c in STATISTICS]))
    parts = max(1, -(-min(n, max_rows) // PART_ROWS))
    unseen = F.pmod(F.shiftright("_h", 8), F.lit(CALIBRATE)) == 0
    model.weights = _solve(rows.where(~unseen).repartition(parts), model)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"raw": model.raw(_matrix(df)), "label": df["label"].to_numpy()})

    held = rows.where(unseen).mapInPandas(scored, "raw double, label int")
    span = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("raw") + model.base + 1) / 3 * BINS)))
    bins = held.groupBy(span.alias("bin")).agg(F.avg("raw").alias("x"), F.sum("label").alias("hits"), F.count("*").alias("rows")).orderBy("bin").toPandas()
    if len(bins):
        model.knots, model.levels = isotonic(bins["x"].to_numpy(), bins["hits"].to_numpy(float), bins["rows"].to_numpy(float))
    else:  # too few labels for both parts
        model.weights = None
    scratch.drop_all()
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """_key, _held and score of every row of stats."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield df[["_key", "_held"]].assign(score=model(_matrix(df)))

    return stats.select("_key", "_held", *STATISTICS).mapInPandas(apply, f"_key {stats.schema['_key'].dataType.simpleString()}, _held boolean, score double")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """key, held_out, score and predicted of every document; rows held out (by the crc32 of the key) teach nothing."""
    held = F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == 0, F.lit(True))
    scratch = Scratch(docs.sparkSession)
    cols = statistics(F.col(text))
    stats = scratch.put("stats", docs.select(F.col(key).alias("_key"), held.alias("_held"), *[c.cast("double").alias(n) for n, c in cols.items()]))
    model = fit(stats.where("not _held"), labels, key, label, max_rows)
    out = score(stats, model).select(F.col("_key").alias(key), F.col("_held").alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
    out = Scratch(docs.sparkSession).put("scores", out)
    scratch.drop_all()
    return out
