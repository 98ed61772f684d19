"""Endpoints and context edges against a walk over the sections of each book."""

import collections
import random

from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import graph as G
from evigraph.operators import linking as L
from evigraph.plans import graph_plans, linking_plans

SF = "/root/testdata/sf0.001"


def walk(rows):
    """Edges by key, added one after another."""
    out = {}
    books = collections.defaultdict(lambda: collections.defaultdict(dict))
    for b, s, key, pos, chunk in sorted(rows, key=lambda r: r[3]):
        books[b][s].setdefault(key, (pos, chunk))
    for b, sections in books.items():
        def add(a, c, relation, kind, s):
            if a == c or (b, a, c, relation) in out:
                return 0
            out[b, a, c, relation] = (kind, s)
            return 1
        hubs = []
        for s in sorted(sections):
            names = sorted(sections[s], key=lambda k: (sections[s][k][0], k))
            hubs.append((s, names[0]))
            for x in names[1:9]:
                add(names[0], x, "CONTAINS", "hub", s)
            for x, y in list(zip(names, names[1:]))[:10]:
                add(x, y, "PARALLEL_WITH", "adjacent", s)
            chunks = {}
            for x in names:
                if sections[s][x][1] is not None:
                    chunks.setdefault(sections[s][x][1], []).append(x)
            n = 0
            for own in chunks.values():
                for x, y in zip(own, own[1:]):
                    n += n < 8 and add(x, y, "MENTIONED_IN", "chunk", s)
        for (_, x), (s, y) in zip(hubs, hubs[1:]):
            add(x, y, "PARALLEL_WITH", "section", s)
    return out


def test_context_edges_match_a_walk(spark):
    rng = random.Random(15)
    rows = []
    for b in "abc":
        for s in range(25):
            names = [f"k{i}" for i in range(18 if b == "a" else 60)] if b != "c" else [f"k{i}" for i in range(14)]
            own = names if b == "c" else rng.sample(names, rng.choice([1, 5, 14]))
            rows += [(b, s, k, i, f"c{rng.choice([0, 0, 1])}" if rng.random() < 0.9 else None) for i, k in enumerate(own)]
    rows += [("a", 3, "k1", 40, "c0"), (None, 1, "k1", 0, "c"), ("b", None, "k1", 0, "c"), ("d", 1, "only", 0, "c0")]
    df = spark.createDataFrame(rows, "book string, section long, name_key string, pos long, chunk_id string")
    got = {(r.book, r.source, r.target, r.relation): (r.kind, r.section) for r in L.context_edges(df).collect()}
    assert got == walk([r for r in rows if r[0] is not None and r[1] is not None])
    assert L.context_edges(df.limit(0)).count() == 0


def test_endpoints_are_found_in_the_section_then_in_the_book_so_far(spark):
    members = [("b", 1, "x", 0, None), ("b", 2, "y", 0, None), ("b", 3, "x", 0, None), ("c", 1, "z", 0, None)]
    drafts = [("b", 1, "X", "y"), ("b", 2, " x", "Y"), ("b", 3, "x", "y"), ("b", 3, "x", "X"), ("b", 3, "z", "x"), ("b", 3, None, "x"), ("c", 1, "z", "z")]
    df = spark.createDataFrame(members, "book string, section long, name_key string, pos long, chunk_id string")
    out = L.resolve(spark.createDataFrame(drafts, "book string, section long, source_name string, target_name string"), df)
    got = {(r.book, r.section, r.source_name, r.target_name): (r.source_at, r.target_at) for r in out.collect()}
    assert got == {
        ("b", 1, "X", "y"): ("section", None), ("b", 2, " x", "Y"): ("document", "section"), ("b", 3, "x", "y"): ("section", "document"), ("b", 3, "x", "X"): ("section", "section"),
        ("b", 3, "z", "x"): (None, "section"), ("b", 3, None, "x"): (None, "section"), ("c", 1, "z", "z"): ("section", "section"),
    }
    assert {r.book: (r.n_drafts, r.n_skipped) for r in L.misses(out).collect()} == {"b": (6, 4), "c": (1, 1)}
    assert L.resolved_edges(out).count() == 2


def test_context_union_of_all_documents_matches_a_walk(spark):
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    grounded = G.ground(graph_plans._terms(spark, SF), graph_plans._chunks(spark, SF), "doc_id").withColumn("key", T.normalize_name(F.col("name"))).collect()
    rows = [(source[r.doc_id], r.doc_id, r.key, r.pos, r.chunk_id) for r in grounded]
    got = {(r.book, r.source, r.target, r.relation): (r.kind, r.section) for r in linking_plans.context_union(spark, SF).collect()}
    assert got == walk(rows)
