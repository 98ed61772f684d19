"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

`features` counts, over whole texts, what the rules look at. `badness` folds the ratios into one
score (1 means that a ratio has reached its scale). `calibrate` picks, for each stratum, the lowest
cutoff whose false-rejection rate on labelled good documents is at most `risk`, by the exact
(Clopper-Pearson) binomial bound. Cutoffs are tested in order from the most lenient one, and the
first that fails ends the stratum's sequence (fixed-sequence testing), so only the number of strata
needs correcting for: each has the level `level / strata` (Bonferroni). With probability
`1 - level` all strata hold their limit at once. A stratum with too few labels to prove anything
rejects nothing beyond the base rules.

Nulls: a null text counts as empty; a null stratum is a stratum of its own; null labels are not
used. An empty table gives an empty result, and no labels give no cutoffs. Repeated rows are judged
each on its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_chars, has_word, materialize, word_array

#: Scales of the ratios: at this value a ratio alone gives a badness of 1.
SCALES = {"symbols": 0.05, "exclaimed": 0.08, "capitals": 0.35, "dup_lines": 0.34, "repeats": 0.45}
#: Cutoffs of the badness, tested in this order.
CUTOFFS = (4.0, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.0)
RISK, LEVEL = 0.02, 0.05
SYMBOLS = "#*$%&|<>"

_P = "_q_"


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_exclaimed, n_capitals (all long).

    n_repeat_words counts the words inside 3-word windows that occur twice or more: windows are
    hashed to 64 bits, packed with their position into one long, sorted, and equal neighbours are
    found by one pass, so a text of n words takes n log n steps and never leaves its row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumns({_P + "t": t, _P + "w": word_array(t)})
    out = out.withColumn(_P + "n", F.size(_P + "w").cast("long"))
    out = out.withColumn(
        _P + "h",
        F.expr(
            f"if({_P}n < 3, array(), transform(sequence(0, cast({_P}n as int) - 3), i -> "
            f"xxhash64({_P}w[i], {_P}w[i + 1], {_P}w[i + 2])))"
        ).cast("array<bigint>"),
    )
    # k bits hold a position; the sort key keeps the hash's other bits
    out = out.withColumn(_P + "k", F.length(F.bin(_P + "n")))
    out = out.withColumn(
        _P + "s",
        F.expr(
            f"if(size(array_distinct({_P}h)) = size({_P}h), array(), "
            f"sort_array(transform({_P}h, (x, i) -> shiftleft(shiftrightunsigned(x, {_P}k), {_P}k) | cast(i as bigint))))"
        ),
    )
    out = out.withColumn(
        _P + "o", F.expr(f"transform({_P}s, x -> cast(x & (shiftleft(1L, {_P}k) - 1) as int))")
    ).withColumn(_P + "g", F.expr(f"transform({_P}o, i -> {_P}h[i])"))
    out = out.withColumn(
        _P + "d",
        F.expr(
            f"sort_array(filter({_P}o, (p, j) -> (j > 0 and {_P}g[j] = {_P}g[greatest(j - 1, 0)]) or "
            f"coalesce(get({_P}g, j + 1) = {_P}g[j], false)))"
        ),
    )
    repeat = F.expr(
        f"if(size({_P}d) = 0, 0L, 3L + aggregate({_P}d, named_struct('last', {_P}d[0], 'sum', 0L), "
        f"(a, p) -> named_struct('last', p, 'sum', a.sum + least(3, p - a.last)), a -> a.sum))"
    )
    lines = F.filter(F.split(F.col(_P + "t"), "\n", -1), has_word)
    out = out.withColumn(_P + "l", lines)
    out = out.withColumns(
        {
            "n_words": F.col(_P + "n"),
            "word_chars": F.length(F.array_join(_P + "w", "")).cast("long"),
            "n_symbols": count_chars(F.col(_P + "t"), SYMBOLS),
            "n_lines": F.size(_P + "l").cast("long"),
            "n_dup_lines": (F.size(_P + "l") - F.size(F.array_distinct(_P + "l"))).cast("long"),
            "n_repeat_words": repeat.cast("long"),
            "n_exclaimed": count_chars(F.col(_P + "t"), "!"),
            "n_capitals": (F.length(_P + "t") - F.length(F.regexp_replace(_P + "t", "[A-ZÀ-ÖØ-Þ]+", ""))).cast("long"),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith(_P)])


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def badness() -> Column:
    """0 or more; the largest of the ratios, each divided by its scale."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return F.greatest(
        per("n_symbols", "word_chars") / SCALES["symbols"],
        per("n_exclaimed", "word_chars") / SCALES["exclaimed"],
        per("n_capitals", "word_chars") / SCALES["capitals"],
        per("n_dup_lines", "n_lines") / SCALES["dup_lines"],
        per("n_repeat_words", "n_words") / SCALES["repeats"],
    )


def upper_bound(k: int, n: int, level: float) -> float:
    """The exact upper limit, at 1 - level, of a binomial rate with k cases in n."""
    if n <= 0 or k >= n:
        return 1.0

    def at_most_k(p: float) -> float:  # P(X <= k), summed from logarithms
        logs = [
            math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
            for i in range(k + 1)
        ]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid in (0.0, 1.0):
            break
        low, high = (mid, high) if at_most_k(mid) > level else (low, mid)
    return high


def calibrate(
    scored: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", good: str = "quality",
    score: str = "badness", cutoffs: tuple = CUTOFFS, risk: float = RISK, level: float = LEVEL,
) -> dict:
    """The cutoff of each stratum that has one. scored: key, stratum, score; labels: key, good (1: good).

    Only the counts of good rows and of false rejections come to the driver, one row a stratum.
    A rejection is a score of the cutoff or more.
    """
    held = scored.select(F.col(key).alias("k"), F.col(stratum).alias("s"), F.col(score).alias("x")).join(
        labels.where(F.col(good) == 1).select(F.col(key).alias("k")).distinct(), "k"
    )
    rows = held.groupBy("s").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("x") >= c).alias(f"r{i}") for i, c in enumerate(cutoffs)]
    ).collect()
    found: dict = {}
    for r in rows:
        for i, c in enumerate(cutoffs):
            # a rate already above the limit cannot pass; this also keeps the sum below short
            if r[f"r{i}"] > risk * r["n"] or upper_bound(r[f"r{i}"], r["n"], level / len(rows)) > risk:
                break
            found[r["s"]] = c
    return found


def rejected(cutoffs: dict, stratum: Column, score: Column) -> Column:
    """Whether a row's score reaches the cutoff of its stratum; false where there is none."""
    limit = F.lit(None).cast("double")
    for s, c in sorted(cutoffs.items(), key=lambda x: (x[0] is not None, str(x[0]))):
        limit = F.when(stratum.eqNullSafe(F.lit(s)), F.lit(c)).otherwise(limit)
    return F.coalesce(score >= limit, F.lit(False))


def judge(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", carry: tuple = (),
) -> DataFrame:
    """key, the carried columns, the counts, base_failed, badness and kept of every row of docs."""
    counted = features(docs.select(key, stratum, text, *[c for c in carry if c not in (key, stratum, text)]), text)
    counted = counted.withColumn("badness", badness()).withColumn("base_failed", base_failed())
    held = materialize(counted if text in carry else counted.drop(text))
    cutoffs = calibrate(held, labels, key, stratum)
    return held.withColumn("kept", ~F.col("base_failed") & ~rejected(cutoffs, F.col(stratum), F.col("badness")))
