"""Edits against a walk over the log, as a batch and as a stream; questions against a walk over nodes and paths."""

import collections
import json
import random

from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.functions.lexicon import ZH_MEDICAL
from evigraph.operators import edits as E
from evigraph.operators import questions as Q

DECISIONS = [("integration_decision_a", "keep", "甲", 0.5), ("integration_decision_b", "merge", None, 0.6), ("integration_decision_c", "refine", "", 0.7)]
EDITS = "seq long, decision_id string, action string, content string, confidence double, reason string"


def walk(edits):
    state, out = {d: (a, c, f) for d, a, c, f in DECISIONS}, []
    for seq, d, action, content, confidence, reason in sorted(edits):
        if d in state:
            before = state[d]
            state[d] = (action, content if content is not None else before[1], confidence)
            out.append((seq, d, *state[d], E.REASON + reason, *before))
    return out, state


def log(rng, n, first=0):
    return [(first + i, rng.choice([d[0] for d in DECISIONS[:2]] + ["gone"]), rng.choice(["keep", "remove", "merge"]), rng.choice([None, None, "乙", "丙丁"]), round(rng.random(), 3), f"r{i}") for i in range(n)]


def test_replay_matches_a_walk(spark):
    edits = log(random.Random(11), 200)
    decisions = spark.createDataFrame(DECISIONS, "decision_id string, action string, content string, confidence double")
    out = E.replay(decisions, spark.createDataFrame(edits, EDITS))
    want, state = walk(edits)
    assert sorted(map(tuple, out.collect())) == want
    got = {r.decision_id: (r.action, r.content, r.confidence) for r in E.applied(decisions, out).collect()}
    assert got == state
    assert E.replay(decisions, spark.createDataFrame([], EDITS)).count() == 0


def test_stream_of_two_batches_equals_the_replay(spark, tmp_path):
    rng = random.Random(12)
    parts = [log(rng, 60), log(rng, 60, 60)]
    names = [c.split()[0] for c in EDITS.split(", ")]
    first = {d: (a, c, f) for d, a, c, f in DECISIONS}
    got = []
    for i, part in enumerate(parts):
        (tmp_path / "log").mkdir(exist_ok=True)
        rows = [dict(zip(names, e)) | dict(zip(("a0", "c0", "f0"), first[e[1]])) for e in part if e[1] in first]
        (tmp_path / "log" / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = spark.readStream.schema(EDITS + ", a0 string, c0 string, f0 double").json(str(tmp_path / "log"))
        q = E.replay_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*[c.split()[0] for c in E.REPLAYED.split(", ")]).collect()))
    assert got == walk(parts[0] + parts[1])[0]


def test_overrides_are_read_from_messages(spark):
    rows = [(1, "请删除 integration_decision_x1", None, None), (2, "合并它", "integration_decision_y", None), (3, "integration_decision_z", None, "keep"), (4, "合并", None, None), (5, "integration_decision_z 很好", None, None)]
    df = spark.createDataFrame([(*r, None, 0.9, None) for r in rows], "seq long, message string, target string, action string, content string, confidence double, reason string")
    assert {(r.seq, r.decision_id, r.action) for r in E.overrides(df, ZH_MEDICAL).collect()} == {(1, "integration_decision_x1", "remove"), (2, "integration_decision_y", "merge"), (3, "integration_decision_z", "keep")}


def test_concepts_follow_their_decisions(spark):
    edits = [(1, "integration_decision_a", "merge", "新", 0.9, "r"), (2, "integration_decision_b", "remove", None, 0.9, "r"), (3, "integration_decision_a", "remove", "末", 0.9, "r")]
    decisions = spark.createDataFrame(DECISIONS, "decision_id string, action string, content string, confidence double")
    concepts = spark.createDataFrame([("p", "d", "s", ["integration_decision_a"]), ("q", "d", "s", ["integration_decision_b", "integration_decision_c"]), ("r", "d", "s", [])], "concept_id string, definition string, summary string, decision_ids array<string>")
    out = E.edited_concepts(concepts, E.replay(decisions, spark.createDataFrame(edits, EDITS))).collect()
    assert {r.concept_id: (r.definition, r.summary, r.teacher_action) for r in out} == {"p": ("新", E.REMOVED, "remove"), "q": ("d", E.REMOVED, "remove"), "r": ("d", "s", None)}


# -- questions

NODES = "node_id string, seq long, name string, aliases array<string>, definition string, title string"


def test_terms_and_hits_match_a_walk(spark):
    rng = random.Random(13)
    words = ["细胞", "损伤", "Cell-Death", "ATP", "膜", "炎症 反应", "x"]
    nodes = [(f"n{i}", i, rng.choice(words) + rng.choice(["", "", str(i % 7)]), [rng.choice(words)] if i % 3 == 0 else None, f"tok{i % 4} tok{i % 5}", "b") for i in range(40)]
    concepts = [(1, "细胞学", ["cells"], ["n1", "n2"]), (2, "后者", [], ["n2", "n3"])]
    records = [(1, "别名", "记录名", ["n3", "nowhere"])]
    questions = [(i, " ".join(rng.sample(words + ["cell death", "cells", "别名", "tok1", "tok2 tok3", "炎症反应", "none"], 2))) for i in range(60)] + [(99, None), (98, "")]
    df = spark.createDataFrame(nodes, NODES)
    forms = Q.node_forms(df, spark.createDataFrame(concepts, "seq long, canonical_name string, aliases array<string>, members array<string>"), spark.createDataFrame(records, "seq long, alias string, canonical_name string, node_ids array<string>"))
    asked = spark.createDataFrame(questions, "question_id long, question string")
    named = Q.named_nodes(asked, forms, shard=7, block=11)
    terms = Q.recognised_terms(named, asked, df, forms)
    got = collections.defaultdict(list)
    for r in sorted(terms.collect(), key=lambda r: r.rank):
        got[r.question_id].append(r.term)
    norm_of = {r.t: r.n for r in spark.createDataFrame([(t,) for t in {q for _, q in questions if q} | set(words) | {f for r in forms.collect() for f in r.forms}], "t string").select("t", T.normalize_term(F.col("t")).alias("n")).collect()}
    held = {r.node_id: (r.canonical, r.forms) for r in forms.collect()}
    assert held["n2"][0] == "后者" and held["n3"][0] == "记录名" and held["n1"][0] == "细胞学"
    toks = {r.t: set(r.k) for r in spark.createDataFrame([(t,) for t in [q for _, q in questions if q] + [f"{n[2]} {n[4]}" for n in nodes]], "t string").select("t", T.tokens(F.col("t")).alias("k")).collect()}
    for i, q in questions:
        want = []
        for n in nodes:
            canonical, own = held[n[0]]
            if q and any(f in q or (len(norm_of[f]) >= 2 and norm_of[f] in norm_of[q]) for f in own) and canonical not in want:
                want.append(canonical)
        if not want and q:
            near = sorted(((len(toks[q] & toks[f"{n[2]} {n[4]}"]), held[n[0]][0]) for n in nodes), reverse=True)
            want = list(dict.fromkeys(c for k, c in near if k))[:4]
        assert got[i] == want[:6], (i, q)


def test_paths_match_a_breadth_first_walk(spark):
    rng = random.Random(14)
    relations = ["CAUSES", "IS_A", "CONTAINS", "ALIAS_OF"]
    edges = [(f"e{i}", f"n{rng.randrange(25)}", f"n{rng.randrange(25)}", rng.choice(relations), round(rng.random(), 1), None) for i in range(40)]
    pairs = [(f"n{a}", f"n{b}") for a in range(25) for b in range(0, 25, 3) if a != b]
    df = spark.createDataFrame(edges, "edge_id string, source string, target string, relation string, confidence double, description string")
    out = Q.pair_paths(spark.createDataFrame(pairs, "a string, b string"), df, 4).collect()
    got = {(r.a, r.b): [s.edge_id for s in r.path] for r in out}
    prio = {"CAUSES": 1, "IS_A": 6, "CONTAINS": 8}
    near = collections.defaultdict(list)
    for e, s, t, r, c, _ in edges:
        if r in prio and s != t:
            near[s].append((prio[r], -c, e, t))
            near[t].append((prio[r], -c, e, s))
    for a, b in pairs:
        queue, seen, want = collections.deque([(a, [])]), {a}, None
        while queue and want is None:
            at, path = queue.popleft()
            for _, _, e, x in sorted(near[at]) if len(path) < 4 else []:
                if x == b:
                    want = [*path, e]
                    break
                if x not in seen:
                    seen.add(x)
                    queue.append((x, [*path, e]))
        assert got.get((a, b)) == want, (a, b)
