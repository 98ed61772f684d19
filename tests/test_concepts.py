"""The result of an integration against a walk over clusters and nodes, one by one."""

import random
import re

import pytest

from evigraph.operators import concepts as C

NODE = "group string, node_id string, name string, text string, importance double, frequency long, confidence double, n_chunks long, n_locators long"
MEMBER, CLUSTER = "cluster string, node_id string, pos long", "cluster string, name string, confidence double"
CANDIDATE = "candidate string, l string, r string, relation string, confidence double, reason string, rank long"
WORDS = ["细胞膜的结构", "炎症反应", "action potential", "membrane", "免疫系统", "heart", "动作电位产生。", "cell"]


def tokens(text):
    pairs = [run[i : i + 2] for run in re.findall("[一-龥]{2,}", text) for i in range(len(run) - 1)]
    return set(pairs + re.findall("[a-z0-9_]{2,}", text.lower()))


def truncate(text, limit):
    return text if len(text) <= limit else re.sub("[ ，,；;。]+$", "", text[: limit - 1]) + "…"


def made(rng, n):
    """n nodes of two reports: a third of all in one cluster, small clusters, single nodes, and members that do not exist."""
    nodes, members, candidates = [], [], []
    for i in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9)))
        text = None if i % 41 == 5 else text
        nodes.append(("a" if i % 3 else "b", f"n{i}", None if i % 37 == 3 else rng.choice(WORDS), text, round(rng.randrange(10, 60) / 10, 4), rng.randrange(1, 5), rng.choice([0.0, 0.6, 0.95]), rng.randrange(3), rng.randrange(2)))
        cluster = "big" if i % 3 == 1 else f"b{i % 5}" if i % 3 == 0 and i % 2 else f"a{i}" if i % 7 == 2 and i % 3 == 2 else None
        if cluster:
            members.append((cluster, f"n{i}", (i * 7) % 101))
    members += [("big", "gone", -1), ("a2", "gone too", 5)]
    for i in range(2 * n):
        l, r = rng.sample(range(n), 2)
        if i % 2:
            r = (l + 3) % n
        relation = rng.choice(["SAME_AS"] * 6 + ["REFINES", "CONFLICTS_WITH"]) if l % 3 == r % 3 else "SAME_AS"
        relation = "SAME_AS" if relation == "REFINES" and l % 3 == 1 else relation
        candidates.append((f"c{i}", f"n{l}", f"n{r}", relation, 0.7, rng.choice([None, f"why{i}"]), (i * 13) % 97))
    candidates += [("lost", "n1", "gone", "CONFLICTS_WITH", 0.7, "x", 0), ("finer", "n3", "n33", "REFINES", 0.7, "finer", 0)]
    names = {m[0] for m in members}
    return nodes, members, [(c, "N" + c, 0.9) for c in sorted(names)], candidates


def walk(nodes, members, clusters, candidates, ratio, original):
    W, by_id = C.ZH, {n[1]: (n[0], n[1], n[2] or "", n[3] or "", *n[4:]) for n in nodes}
    guarded = {x for c in candidates if c[3] == "CONFLICTS_WITH" and c[1] in by_id and c[2] in by_id for x in c[1:3]}
    drafts, covered = {}, set()
    for cluster, name, confidence in clusters:
        own = [by_id[m[1]] for m in sorted((m for m in members if m[0] == cluster), key=lambda m: (m[2], m[1])) if m[1] in by_id]
        if len(own) < 2:
            continue
        ids = {n[1] for n in own}
        covered |= ids
        inside = sorted((c for c in candidates if c[1] in ids and c[2] in ids), key=lambda c: (c[6], c[0]))
        action = "refine" if any(c[3] == "REFINES" for c in inside) else "merge"
        rep = min(own, key=lambda n: (-len(n[3]), 0, -n[7], n[2], n[1]))
        base = tokens(rep[3])
        adds = [n[3] for n in own if n is not rep and n[3] and (action == "refine" or len(base & tokens(n[3])) < max(2, len(base) // 5))][:2]
        text = W.supplement % (rep[3], " ".join(adds)) if adds else rep[3]
        said = "；".join([c[5] for c in inside if c[5] is not None][:2])
        why = said or (W.refine_without if action == "refine" else W.merge_without)
        reason = (W.refine_reason if action == "refine" else W.merge_reason) % (name, rep[2], len(own) - 1, why)
        held = bool(ids & guarded)
        drafts[cluster] = dict(group=own[0][0], action=action, name=name, n=len(own), text=text, importance=round(sum(n[4] for n in own), 4), confidence=confidence, force=held, reason=reason, clustered=True)
    for n in by_id.values():
        if n[1] not in covered:
            held = n[1] in guarded
            reason = W.guarded_reason % n[2] if held else W.keep_reason % (n[2], n[4], n[5])
            drafts[n[1]] = dict(group=n[0], action="keep", name=n[2], n=1, text=n[3], importance=n[4], confidence=n[6], force=held or n[4] >= 4.5, reason=reason, clustered=False)
    for group, size in original.items():
        budget = max(1, int(size * ratio))
        own = {k: d for k, d in drafts.items() if d["group"] == group}
        need = sum(min(len(d["text"]), 48) for d in own.values())
        order = sorted((k for k, d in own.items() if d["action"] == "keep" and not d["force"]), key=lambda k: (own[k]["importance"], len(own[k]["text"]), own[k]["name"], k))
        for k in order:
            if need <= budget:
                break
            d = own.pop(k)
            need -= min(len(d["text"]), 48)
            d |= dict(action="remove", definition=None, reason=W.remove_reason % d["name"], confidence=max(0.55, min(0.86, d["confidence"] or 0.72)))
        ties = [k for k in sorted(own, key=lambda k: (-own[k]["importance"], own[k]["name"], own[k]["clustered"], k))]
        rest = [own[k] for k in ties]
        left, weight = budget, 0.0
        for d in rest:
            weight += max(1.0, d["importance"])
        for i, d in enumerate(rest):
            w = max(1.0, d["importance"])
            most = left if i == len(rest) - 1 else min(max(12, int(left * w / weight)), left - 12 * (len(rest) - i - 1))
            used = min(max(1, most), len(d["text"]))
            d["definition"] = truncate(d["text"], used)
            left, weight = left - used, weight - w
        over = sum(len(d["definition"]) for d in rest) - budget
        for least in (12, 1):
            for d in reversed(rest):
                gives = min(max(0, len(d["definition"]) - least), max(0, over))
                if gives:
                    d["definition"] = truncate(d["definition"], len(d["definition"]) - gives)
                    over -= gives
    return drafts, guarded


def built(spark, nodes, members, clusters, candidates):
    make = spark.createDataFrame
    n, m, c, k = make(nodes, NODE), make(members, MEMBER), make(clusters, CLUSTER), make(candidates, CANDIDATE)
    conflicts = C.conflicts(k, n)
    guarded = C.guarded_nodes(conflicts)
    placed = C.placed_members(n, m, k)
    return n, conflicts, placed, C.cluster_drafts(placed, c, k, guarded).unionByName(C.single_drafts(n, placed, guarded))


@pytest.mark.parametrize("ratio", [0.1, 0.6])
def test_matches_a_walk(spark, ratio):
    nodes, members, clusters, candidates = made(random.Random(5), 90)
    original = {g: sum(len(n[3] or "") for n in nodes if n[0] == g) for g in "ab"}
    want, guarded = walk(nodes, members, clusters, candidates, ratio, original)
    n, conflicts, placed, drafts = built(spark, nodes, members, clusters, candidates)
    sizes = spark.createDataFrame(list(original.items()), "group string, original long")
    budgeted = C.within_budget(drafts, sizes, ratio)
    rows = {r.draft: r for r in budgeted.collect()}
    assert set(rows) == set(want)
    for k, d in want.items():
        r = rows[k]
        assert (r.group, r.action, r.name, r.n_members, r.text, r.reason, r.definition) == (d["group"], d["action"], d["name"], d["n"], d["text"], d["reason"], d["definition"]), k
        assert abs(r.importance - d["importance"]) < 1e-9 and abs(r.confidence - d["confidence"]) < 1e-9 and r.force_retain == d["force"]
    assert {"merge", "refine", "keep"} <= {d["action"] for d in want.values()} and (ratio > 0.5 or any(d["action"] == "remove" for d in want.values()))

    decided, made_ = C.decisions(budgeted, conflicts), C.concepts(budgeted)
    kept = {k: d for k, d in want.items() if d["action"] != "remove"}
    assert {r.draft: r.definition for r in made_.collect()} == {k: d["definition"] for k, d in kept.items()}
    n_conflicts = sum(c[3] == "CONFLICTS_WITH" and c[2] != "gone" for c in candidates)
    assert decided.count() == len(want) + n_conflicts and decided.select("decision_id").distinct().count() == decided.count()
    links = C.concept_decisions(made_, decided, conflicts, C.draft_members(budgeted, placed))
    of = {m[1]: m[0] for m in members if m[0] in want} | {k: k for k, d in want.items() if not d["clustered"]}
    ends = {(of[x], c[0]) for c in candidates if c[3] == "CONFLICTS_WITH" and c[2] != "gone" for x in c[1:3] if of[x] in kept}
    assert links.count() == len(kept) + len(ends)
    total = {r.group: r for r in C.totals(made_, decided, n, sizes, ratio).collect()}
    for g in "ab":
        own = [d for d in want.values() if d["group"] == g]
        assert total[g].retained == sum(len(d["definition"]) for d in own if d["action"] != "remove")
        assert total[g].merged == sum(d["n"] - 1 for d in own if d["action"] == "merge") and total[g].removed == sum(d["action"] == "remove" for d in own)
        assert total[g].refined == sum(max(1, d["n"] - 1) for d in own if d["action"] == "refine")


def test_redundant_members_are_rows(spark):
    nodes, members, clusters, candidates = made(random.Random(6), 60)
    _, _, placed, _ = built(spark, nodes, members, clusters, candidates)
    rows = C.redundancies(placed).collect()
    reps = {r.cluster: r.rep.node_id for r in placed.collect()}
    known = {n[1]: n for n in nodes}
    want = {(m[0], m[1]) for m in members if m[0] in reps and m[1] in known and reps[m[0]] != m[1]}
    assert {(r.draft, r.node_id) for r in rows} == want and len(rows) == len(want)
    assert all(r.detail == f"{known[r.node_id][2] or ''}: {truncate(known[r.node_id][3] or '', 80)}" for r in rows)


def test_empty_tables(spark):
    n, conflicts, placed, drafts = built(spark, [], [], [], [])
    budgeted = C.within_budget(drafts, spark.createDataFrame([("a", 0)], "group string, original long"))
    decided, made_ = C.decisions(budgeted, conflicts), C.concepts(budgeted)
    assert decided.count() == 0 and made_.count() == 0 and C.redundancies(placed).count() == 0
    total = C.totals(made_, decided, n, spark.createDataFrame([("a", 0)], "group string, original long")).collect()
    assert [(r.n_concepts, r.retained, r.ratio, r.target_met) for r in total] == [(0, 0, 0.0, True)]
