"""The shown part of graphs against a walk over whole graphs."""

import random

import pytest

from evigraph.operators import display as D
from evigraph.plans import graph_plans


def walk(nodes, edges, n):
    """Chosen nodes, edges and lone nodes of one graph, over all its rows."""
    budget = max(60, int(n * 2.35))
    score = {i: base for i, _, base in nodes}
    name = {i: x for i, x, _ in nodes}
    for _, a, b, s, _ in edges:
        score[a] += s
        score[b] += s
    order = sorted(score, key=lambda i: (-round(score[i], 6), name[i], i))
    if len(nodes) <= n and len(edges) <= budget:
        return order, [e[0] for e in sorted(edges)]
    near = {i: [] for i in score}
    for _, a, b, s, _ in sorted(edges, key=lambda e: (-e[3], e[0])):
        near[a].append(b)
        near[b].append(a)
    chosen = order[: min(n, max(24, int(n * 0.58)))]
    while len(chosen) < min(n, len(order)):
        size = len(chosen)
        for i in list(chosen):
            fresh = [x for x in near[i] if x not in chosen]
            chosen += fresh[:1]
            if len(chosen) >= n:
                break
        if len(chosen) == size:
            chosen.append(next(i for i in order if i not in chosen))
    degree, context, taken = dict.fromkeys(score, 0), dict.fromkeys(score, 0), []
    inside = sorted((e for e in edges if e[1] in chosen and e[2] in chosen), key=lambda e: (e[4], -e[3], e[0]))
    for q, a, b, s, c in inside:
        if len(taken) >= budget:
            break
        if c:
            ok = 0 in (degree[a], degree[b]) or (context[a] < 2 and context[b] < 2 and s >= 0.45)
        else:
            ok = degree[a] < 9 or degree[b] < 9
        if ok:
            taken.append(q)
            for x in (a, b):
                degree[x] += 1
                context[x] += c
    lone = [i for i in order if i in chosen and not degree[i]][: max(6, min(18, n // 10))]
    return [i for i in order if i in chosen and (degree[i] or i in lone)], taken


@pytest.mark.parametrize("n", [30, 70])
def test_display_matches_a_walk(spark, n):
    rng = random.Random(n)
    nodes, edges = [], []
    for g, (many, links) in {"big": (150, 500), "hub": (120, 300), "lone": (90, 20), "chain": (60, 59), "small": (12, 8), "dense": (20, 400)}.items():
        own = [(i, rng.choice("abc") + str(rng.randrange(9)), round(rng.random(), 3)) for i in range(many)]
        nodes += [(g, *x) for x in own]
        for q in range(links):
            a, b = (0, rng.randrange(1, many)) if g == "hub" and rng.random() < 0.6 else (q, q + 1) if g == "chain" else rng.sample(range(many), 2)
            edges.append((g, q, a, b, round(rng.choice([0.2, 0.5, 0.5, 1.25]) * rng.choice([1, 1, 2]), 2), rng.random() < 0.4))
    got_nodes, got_edges = D.display(
        spark.createDataFrame(nodes, "graph string, node_id long, name string, base double"),
        spark.createDataFrame(edges, "graph string, seq long, source long, target long, score double, contextual boolean"), n,
    )
    shown = {}
    for r in sorted(got_nodes.collect(), key=lambda r: r.rank):
        shown.setdefault(r.graph, ([], []))[0].append(r.node_id)
    for r in sorted(got_edges.collect(), key=lambda r: r.place):
        shown[r.graph][1].append(r.seq)
    for g in shown:
        want = walk([x[1:] for x in nodes if x[0] == g], [x[1:] for x in edges if x[0] == g], n)
        assert shown[g][0] == want[0], g
        assert shown[g][1] == want[1], g


def test_shown_graphs_of_all_brands_match_a_walk(spark, monkeypatch):
    monkeypatch.setattr(graph_plans, "SHOWN", 30)  # smaller than the given graphs
    nodes, edges = (df.collect() for df in graph_plans._brand_graphs(spark, "/root/testdata/sf0.01"))
    shown = {}
    for r in sorted(graph_plans.shown_nodes(spark, "/root/testdata/sf0.01").collect(), key=lambda r: r.rank):
        shown.setdefault(r.graph, ([], []))[0].append(r.node_id)
    for r in sorted(graph_plans.shown_edges(spark, "/root/testdata/sf0.01").collect(), key=lambda r: r.place):
        shown[r.graph][1].append(r.seq)
    assert len(shown) == 25
    for g, found in shown.items():
        want = walk([(r.node_id, r.name, r.base) for r in nodes if r.graph == g], [(r.seq, r.source, r.target, r.score, r.contextual) for r in edges if r.graph == g], 30)
        assert found == (want[0], want[1]), g
