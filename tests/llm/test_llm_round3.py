"""Classifier, filter audit and prefix trie against brute force, and on nulls, empty texts and tables, ties and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.llm import audit, classifier, queries, trie

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def clashing(df):
    for name in ("_row", "n", "f1", "size", "score", "removed", "part", "step", "label"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("clash"))
    return df


# -- filter audit


def documents(spark, rows):
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def audited(rows, labels):
    """The report by sets of row numbers, order by order."""
    fails = {n: set() for n in "ABCDE"}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for k, (i, t, _) in enumerate(rows):
        t = t or ""
        w = re.findall(WORD, t)
        fails["A"] |= {k} if len(w) < 100 else set()
        fails["B"] |= {k} if 100 * len(set(w)) < 80 * len(w) else set()
        fails["C"] |= {k} if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else set()
        fails["D"] |= {k} if re.search("[#$%&*|]", t) else set()
        fails["E"] |= {k} if i is not None and first[t] < i else set()
    marked = [{i for i, *v in labels if i is not None and v[j] == 1} for j in (0, 1)]
    out = {}
    for part in {p or "" for _, _, p in rows}:
        own = {k for k, r in enumerate(rows) if (r[2] or "") == part}
        removed = {}
        for order in itertools.permutations("ABCDE"):
            left = set(own)
            for step, f in enumerate(order, 1):
                gone = left & fails[f]
                others = set().union(*(fails[g] for g in "ABCDE" if g != f))
                lost = [sum(rows[k][0] in m for k in gone) for m in marked]
                out[part, "".join(order), step] = [len(left - gone), len(gone), len((own & fails[f]) - left), len((own & fails[f]) - others), *lost]
                removed[f] = removed.get(f, 0) + len(gone)
                left -= gone
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed[order[step - 1]])
    return out


def test_audit_matches_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "beta", "GAMMA", "d#lta", "Eps", "z", "eta\n", "théta"]) + str(rng.randrange(40))
    texts = [" ".join(word() for _ in range(rng.choice([3, 60, 120, 300]))) for _ in range(25)] + [" ".join(f"w{i}" for i in range(150))]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(120)]
    rows += [(500, None, "en"), (501, "", "en"), (502, " \t", "fr"), (None, texts[0], "en"), (None, texts[0], "en"), (7, texts[1], "de"), (7, texts[1], "de"), (503, "long " * 40_000, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 130, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    out = audit.audit(documents(spark, rows), clashing(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in out}
    assert len(out) == len(got) == 600 * 4
    assert got == audited(rows, labels)


def test_audit_of_other_filters_and_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(documents(spark, []), labels).count() == 0
    own = {"S": lambda t, w: F.length(t) < 3, "L": lambda t, w: F.size(w) > 3}
    rows = [(1, "ab", "x"), (2, "a b c d", "x"), (3, "abc", "x")]
    out = {(r.filter_order, r.step): (r.kept, r.removed) for r in audit.audit(documents(spark, rows), labels, own, copies=None).collect()}
    assert out == {("SL", 1): (2, 1), ("SL", 2): (1, 1), ("LS", 1): (2, 1), ("LS", 2): (1, 1)}
    with pytest.raises(ValueError):
        audit.audit(documents(spark, rows), labels, {"AB": own["S"]})


# -- prefix trie


def told(rows):
    """The nodes by dictionaries of prefixes."""
    said = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            said[c].append((turn is not None, turn or 0, key, role or "", text or ""))
    own = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in said.items()}
    new = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        new[c] = own.get(base, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n],
         hashlib.sha256(",".join(str(c) for c in sorted(c for c in m if len(new[c]) == len(n))).encode()).hexdigest())
        for n, m in members.items()
    )


def conversations(spark, rows):
    return clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def built(spark, rows, limit=None):
    out = trie.trie(conversations(spark, rows), limit).collect()
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out)


ODD = [
    (1, None, None, None), (1, None, "user", "x"), (1, 3, "user", "é"), (1, 3, "user", "é"), (None, 0, "user", "x"), (-3, 1, "user", "x"), (-5, 1, "user", "y"), (-5, 0, "", "z"),
    (90, 0, "user", "long " * 30_000), (91, 0, "user", "x"), (10**15, 5, "user", "x"),
]


@pytest.mark.parametrize("limit", [1, 4, None])
def test_trie_matches_brute_force(spark, limit):
    rng = random.Random(4)
    rows = list(ODD)
    for c in range(150):
        same = rng.random() < 0.5
        for k in range(rng.choice([1, 2, 3, 9, 14])):
            rows.append((c, k, rng.choice(["user", "user", None]), "opening" if same and k < 2 else rng.choice("abc")))
    rows += [(c, k, "user", f"deep {k}") for c in (200, 205, 206) for k in range(300)]
    rng.shuffle(rows)
    assert built(spark, rows, limit) == told(rows)


def test_trie_of_nothing_and_of_one_copied_conversation(spark):
    assert trie.trie(conversations(spark, [])).count() == 0
    rows = [(c, k, "user", f"t{k}") for c in range(1500) for k in range(3)]
    assert built(spark, rows) == told(rows)


def test_split_sums_any_forest():
    rng = np.random.default_rng(5)
    for n in (1, 2, 60, 400):
        for shape in ("path", "star", "random"):
            parent = {"path": np.arange(n) - 1, "star": np.zeros(n, int), "random": np.array([rng.integers(0, max(i, 1)) for i in range(n)])}[shape]
            parent[0] = 0
            parent[rng.random(n) < 0.05] = -1
            parent = np.where(parent < 0, np.arange(n), parent)
            depth, top = np.zeros(n, int), np.arange(n)
            size, values = np.ones(n, int), rng.integers(0, 9, (n, 2))
            want = values.copy()
            for i in range(n):
                if parent[i] != i:
                    depth[i], top[i] = depth[parent[i]] + 1, top[parent[i]]
            for i in reversed(range(n)):
                if parent[i] != i:
                    size[parent[i]] += size[i]
                    want[parent[i]] += want[i]
            assert (trie.split(parent, depth, size, top, values) == want).all()


# -- classifier


def test_classifier_on_labels_held_out(spark):
    out = queries.op11_quality_classifier(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").toPandas()
    assert sorted(out["doc_id"]) == sorted(docs["doc_id"])
    assert (out["held_out"] == out["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.3)).all()
    known = out.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    known = known[known["held_out"]]
    good, bad = known[known["quality"] == 1]["score"], known[known["quality"] == 0]["score"]
    assert np.mean([(good > b).mean() for b in bad]) > 0.95
    assert (known["predicted"] == known["quality"]).mean() > 0.9


def test_classifier_ignores_labels_held_out_and_scores_odd_rows(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "efg", "hi"]) + str(rng.randrange(9)) * (i % 2) for _ in range(80)), "en") for i in range(300)]
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "x " * 50_000, None), (None, "no key", "en"), (5, rows[5][1], "fr")]
    labels = [(i, i % 2, 0) for i in range(300)]
    table = lambda ls: clashing(spark.createDataFrame(ls, "doc_id long, quality int, toxic int"))
    scores = lambda ls: {(r.doc_id, r.held_out, r.score, r.predicted) for r in classifier.classify(documents(spark, rows + odd), table(ls)).collect()}
    first = scores(labels)
    assert len(first) == 304 and all(0 <= s <= 1 for _, _, s, _ in first)
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    changed = [(i, 1 - q if i in held else q, t) for i, q, t in labels] + [(None, 1, 1), (7777, 1, 0), (3, None, None)]
    assert scores(changed) == first
    assert sum(p == i % 2 for i, h, s, p in first if i in held) == len(held)


def test_classifier_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert classifier.classify(documents(spark, []), none).count() == 0
    rows = documents(spark, [(1, "a", "en"), (2, None, "en")])
    assert {r.score for r in classifier.classify(rows, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in classifier.classify(rows, one).collect()} == {1.0}


def test_statistics_match_python(spark):
    texts = ["Ab ab ab, 12 #x\nAb ab ab, 12 #x\n\nend!", "", " ", "É| |"]
    out = spark.createDataFrame([(t,) for t in texts], "text string").select(*[c.alias(n) for n, c in classifier.statistics(F.col("text")).items()]).collect()
    for t, r in zip(texts, out, strict=True):
        w = re.findall(WORD, t)
        n, chars = max(len(w), 1), max(sum(map(len, w)), 1)
        lines = [x for x in t.split("\n") if x.strip()]
        assert r.distinct == pytest.approx(len(set(w)) / n)
        assert r.again == pytest.approx(sum(a == b for a, b in itertools.pairwise(w)) / n)
        assert r.pipes == pytest.approx(t.count("|") / chars) and r.exclaimed == pytest.approx(t.count("!") / chars)
        assert r.capitals == pytest.approx(sum(c.isupper() for c in t) / chars)
        assert r.dup_lines == pytest.approx((len(lines) - len(set(lines))) / max(len(lines), 1))


def test_isotonic_levels_rise_and_pool():
    knots, levels = classifier.isotonic(np.arange(6.0), np.array([0, 3, 1, 4, 9, 8.0]), np.full(6, 10.0))
    assert (np.diff(knots) > 0).all() and (np.diff(levels) >= 0).all() and 0 < levels[0] <= levels[-1] < 1
    assert len(knots) == 4 + 2  # the second and third, and the last two, are pooled


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((30, 5))
    z = classifier.fourier(x, features=20_000)[:, :-1]
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-far / (2 * classifier.WIDTH**2 * 5))).max() < 0.05
