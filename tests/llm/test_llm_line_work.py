"""What line dedup reads again and how many jobs its steps are: these decide its disk and the driver's memory."""

import random

from evigraph.llm import grouplinks, linededup


def jobs(spark, run):
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setJobGroup("rest", "rest")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_only_lines_of_near_pairs_are_read_again(spark, monkeypatch):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    phrase = [word() for _ in range(6)]
    # all hold one phrase, so that they share runs, but only the last two are near each other
    lines = [" ".join([*(word() for _ in range(24)), *phrase]) for _ in range(18)]
    lines.append(lines[-1] + " more")
    asked = []
    held = linededup._word_lists
    monkeypatch.setattr(linededup, "_word_lists", lambda ids, *rest: asked.append({r.id for r in ids.collect()}) or held(ids, *rest))
    monkeypatch.setattr(linededup, "ANCHORS", 16)
    kept = linededup.dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(range(18))
    assert len(asked) == 1 and len(asked[0]) <= 6


def test_large_groups_against_all_pairs(spark, monkeypatch):
    """Groups over SMALL go by hubs; the result is that of all pairs."""
    rnd = random.Random(5)
    words = [f"word{i}" for i in range(60)]
    base = [rnd.choice(words) for _ in range(12)]
    lines = [base]
    for _ in range(60):
        line = list(rnd.choice(lines))
        line[rnd.randrange(12)] = rnd.choice(words)
        lines.append(line)
    rows = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    want = {r.doc_id for r in linededup.dedup(rows).collect()}
    for small in (0, 4, 1000):
        monkeypatch.setattr(linededup, "SMALL", small)
        assert {r.doc_id for r in linededup.dedup(rows).collect()} == want


def test_a_round_of_classes_is_few_jobs(spark):
    star = spark.createDataFrame([(0, i) for i in range(1, 20)], "a long, b long")
    # a star goes in one round
    assert jobs(spark, lambda: grouplinks.components(star).collect()) <= 20


def test_repeated_rows_and_null_keys_count_once(spark):
    rows = [(None, "one two three four five\nshort\nshort"), (None, "one two three four five\nshort\nshort"), (2, "one two three four six\n\n?"), (3, "?"), (4, None)]
    out = linededup.removals(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r._k, r.n_lines, tuple(r.removed)) for r in out.collect()}
    assert got == {(None, 3, (2,)), (2, 1, (0,)), (3, 0, ()), (4, 0, ())}


def compared(monkeypatch):
    """The pairs of large groups that are left for the last comparison of words."""
    found = []
    held = linededup.pairs_across
    monkeypatch.setattr(linededup, "pairs_across", lambda *a: found.append(held(*a).count()) or held(*a))
    return found


def test_long_lines_that_only_share_a_passage_are_not_compared(spark, monkeypatch):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    passage = [word() for _ in range(160)]
    # a third of the words differ, which bitmaps of 128 bits can't tell from a fifth
    lines = [" ".join([*(word() for _ in range(40)), *passage, *(word() for _ in range(40))]) for _ in range(80)]
    found = compared(monkeypatch)
    kept = linededup.dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert kept.count() == 80
    assert sum(found) <= 80


def test_lines_around_a_passage_against_all_pairs(spark, monkeypatch):
    rnd = random.Random(8)
    passage = [f"passage{i}" for i in range(40)]
    own = lambda: [f"own{rnd.randrange(10**6)}" for _ in range(rnd.randrange(9))]
    lines = [[*own(), *passage, *own()] for _ in range(90)]

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    comp, links = list(range(len(lines))), 0
    for i in range(len(lines)):
        for j in range(i):
            if 5 * apart(lines[i], lines[j]) <= max(len(lines[i]), len(lines[j])):
                links += 1
                x, y = sorted((comp[i], comp[j]))
                comp = [x if c == y else c for c in comp]
    found = compared(monkeypatch)
    kept = linededup.dedup(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(comp)
    assert links > 1000 and sum(found) <= links / 10
