"""Queries on whole tables against brute force of our own."""

import contextlib
import io
import itertools
import math
import random
import re

import numpy as np

from evigraph.functions.lexicon import LATIN
from evigraph.operators import index, integrate
from evigraph.plans import graph_plans, merge_plans, text_plans

SF = "/root/testdata/sf0.001"


def test_keyword_edges_read_whole_documents(spark):
    names: dict[int, list[str]] = {}
    for r in sorted(graph_plans.section_terms(spark, SF).collect(), key=lambda r: (r.doc_id, r.pos)):
        names.setdefault(r.doc_id, []).append(r.name)
    want, late = set(), 0
    for doc in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = (doc.text or "").replace(".", "；")
        said = [x.strip() for x in re.split("(?<=[。！？!?；;])", text) if x.strip()]
        for markers, relation in LATIN.relations:
            own = [x for x in said if any(m in x for m in markers)]
            pairs = ((a, b, x) for a in names.get(doc.doc_id, []) for b in names[doc.doc_id] if a != b for x in own if a in x and b in x)
            for a, b, x in pairs:
                want.add((doc.doc_id, a, b, relation, " ".join(x.split())[:160]))
                late += text.index(x) >= 700
                break
    assert {tuple(r[c] for c in ("doc_id", "source", "target", "relation", "quote")) for r in graph_plans.keyword_edges(spark, SF).collect()} == want
    assert late


def test_components_hold_all_order_lines(spark):
    at: dict[str, str] = {}

    def find(x):
        while at.setdefault(x, x) != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_orderkey").collect():
        a, b = find(f"p{r.l_partkey}"), find(f"o{r.l_orderkey}")
        at[max(a, b)] = min(a, b)
    assert {r.id: r.component for r in graph_plans.components(spark, SF).collect()} == {x: find(x) for x in at}


def test_vector_search_takes_every_twentieth_vector_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(index, "SHARD_ROWS", 60)
    monkeypatch.setattr(index, "BLOCK_ROWS", 10)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, m = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
    want = {}
    for i, own in enumerate(ids):
        if own % 20 == 0:
            scored = sorted((-round(max(0.0, float(m[i] @ m[j])), 6), x) for j, x in enumerate(ids) if x != own)[:5]
            want |= {(own, n): (x, -s) for n, (s, x) in enumerate(scored, 1)}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.cosine) for r in text_plans.vector_topk(spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) == 5 * 25
    assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-6 for x in want)


def test_alignment_keeps_alias_pairs_in_classes_and_decisions(spark):
    nodes = merge_plans._nodes(spark, SF).collect()
    norm = lambda x: re.sub(r"[\s_-]+", "", x.lower())
    keys = {n.node_id: {norm(n.name), norm(n.name.split(" ")[-1])} for n in nodes}
    text = {n.node_id: f"{n.name} {n.definition}" for n in nodes}
    at = {n.node_id: n.node_id for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    pairs, conflicts = {}, set()
    for a, b in itertools.combinations(sorted(nodes, key=lambda n: n.node_id), 2):
        l, r = a.node_id, b.node_id
        if a.book != b.book and keys[l] & keys[r]:
            if "SMALL" in text[l] and "LARGE" in text[r] or "SMALL" in text[r] and "LARGE" in text[l]:
                pairs[l, r] = "CONFLICTS_WITH"
                conflicts |= {a.name, b.name}
            else:
                pairs[l, r] = "ALIAS_OF" if norm(a.name) != norm(b.name) else "same"
                at[max(find(l), find(r))] = min(find(l), find(r))
    found = {(r.l, r.r): r for r in merge_plans.align_candidates(spark, SF).collect()}
    assert found.keys() == pairs.keys() and "ALIAS_OF" in pairs.values()
    assert all(found[x].relation == y for x, y in pairs.items() if y != "same")
    linked = {x for p, y in pairs.items() if y != "CONFLICTS_WITH" for x in p}
    assert {r.node_id: r.cluster for r in merge_plans.align_clusters(spark, SF).collect()} == {x: find(x) for x in linked}
    means: dict[int, list[float]] = {}
    for (l, r), row in found.items():
        if l in linked and r in linked and find(l) == find(r):
            means.setdefault(find(l), []).append(row.confidence)
    got = {r.cluster: r.confidence for r in merge_plans.cluster_confidence(spark, SF).collect()}
    assert got.keys() == means.keys() and all(abs(got[c] - sum(v) / len(v)) < 1e-3 for c, v in means.items())
    assert {r.unit for r in merge_plans.integration_decisions(spark, SF).where("action = 'conflict'").collect()} == conflicts


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_budgets_of_a_large_group_take_no_array_and_no_window_of_all_its_rows(spark):
    rng = random.Random(9)
    rows = [("ab"[i % 7 == 0], i, rng.randrange(1, 400), rng.randrange(1, 49), round(rng.random() * 5, 2), rng.random() < 0.7) for i in range(6000)]
    limits = {"a": 150_000, "b": 9_000}
    df = spark.createDataFrame(rows, "g string, id long, length long, need long, importance double, evictable boolean").repartition(4)
    lim = spark.createDataFrame(list(limits.items()), "g string, limit long")
    gone, chars = set(), {}
    for g, limit in limits.items():
        own = [r for r in rows if r[0] == g]
        left = sum(r[3] for r in own)
        for r in sorted((r for r in own if r[5]), key=lambda r: (r[4], r[1])):
            if left <= limit // 3:
                break
            left -= r[3]
            gone.add(r[1])
        own.sort(key=lambda r: (-r[4], r[1]))
        weight = 0.0
        for r in own:
            weight += max(1.0, r[4])
        left = limit
        for i, r in enumerate(own):
            rest, w = len(own) - i - 1, max(1.0, r[4])
            most = min(max(12, math.floor(left * w / weight)), left - 12 * rest) if rest else left
            chars[g, r[1]] = min(max(1, most), r[2])
            left, weight = left - chars[g, r[1]], weight - w
    out = integrate.evict(df, lim.withColumn("limit", (lim["limit"] / 3).cast("long")), "g", ["importance", "id"])
    assert {r.id for r in out.where("evicted").collect()} == gone and out.count() == len(rows)
    windows = [x for x in plan(out).splitlines() if " Window " in x and "importance" in x]
    assert windows and all("_range" in x for x in windows)
    shares = integrate.allocate(df, lim, "g", "id")
    assert {(r.g, r.id): r.chars for r in shares.collect()} == chars
    assert "collect_list" not in plan(shares)
