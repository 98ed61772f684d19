"""Short lines: links at the very bound of similarity, at the fewest words that can have one."""

import itertools

import pytest

from evigraph.llm import linededup


def kept(spark, lines):
    rows = [(i, line) for i, line in enumerate(lines)]
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r.doc_id for r in got}


@pytest.mark.parametrize("at", range(5))
def test_four_words_and_one_more(spark, at):
    words = ["alpha", "beta", "gamma", "delta"]
    longer = words[:at] + ["epsilon"] + words[at:]
    assert kept(spark, [" ".join(words), " ".join(longer)]) == {0}
    assert kept(spark, [" ".join(longer), " ".join(words)]) == {0}


def test_three_words_and_two_edits_are_no_links(spark):
    assert kept(spark, ["alpha beta gamma", "alpha beta gamma delta"]) == {0, 1}
    assert kept(spark, ["one two three four", "one two three five", "one two", "one two three"]) == {0, 1, 2, 3}


def test_all_short_lines_against_edit_distances(spark):
    lines = [" ".join(w) for n in (3, 4, 5) for w in itertools.islice(itertools.product("abcd", repeat=n), 0, None, 7)]

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    comp = list(range(len(lines)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in itertools.combinations(range(len(lines)), 2):
        a, b = lines[i].split(), lines[j].split()
        longest = max(len(a), len(b))
        if min(len(a), len(b)) >= 4 and abs(len(a) - len(b)) <= 1 and apart(a, b) <= longest * 0.2 + 1e-9:
            x, y = sorted((top(i), top(j)))
            comp[y] = x
    assert kept(spark, lines) == {i for i in range(len(lines)) if top(i) == i}
