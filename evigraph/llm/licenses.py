"""License scans by a generalised suffix automaton over the words of licence templates.

The automaton holds every run of words of every template. Streaming a text through it gives, at each
word, the length of the longest run that ends there and stands in some template (matching statistics).
Maximal runs of `MIN_RUN` words or more are anchored where the template has them; anchors of one
template that follow each other in both text and template, with at most `MAX_GAP` words between, are
chained into spans, and a span that covers `MIN_COVER` of its template, or `MIN_WORDS` of its words,
carries the template's label. Base phrases are templates too and are found wherever their words stand
consecutively, from the same statistics.

Nulls: a null text counts as empty and has no place; a null key is kept. Empty tables give empty
results. Texts of any length are streamed whole, in one pass and with memory for their own words.
Repeated rows are scanned each on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
MIN_RUN, MAX_GAP, MIN_COVER, MIN_WORDS = 4, 8, 0.6, 24

# The base phrases of the scan.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Short, well-known notices of public licences, one or more to a label.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation "
            "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by "
             "the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
)


def words_of(text: str | None) -> list[str]:
    """Words after lower-casing A-Z only."""
    if not text:
        return []
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    return WORD.findall(low)


_LOWER = {c: c + 32 for c in range(65, 91)}


class Automaton:
    """Suffix automaton of several word sequences; states are rows of parallel lists."""

    def __init__(self, templates: list[list[str]], phrases: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: one place (template, end position) where a state's runs end
        self.places: list[dict[int, list[int]]] = [{}]
        ends: list[tuple[int, int, int]] = []
        for t, words in enumerate(templates):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                ends.append((last, t, i))
        for state, t, i in ends:  # a state's places are those of the states below it too
            while state > 0:
                self.places[state].setdefault(t, []).append(i)
                state = self.link[state]
        self.phrases: list[tuple[int, int]] = []
        for words in phrases:
            state = 0
            for w in words:
                state = self.next[state][w]
            self.phrases.append((state, len(words)))
        #: phrases whose state is this one (to be checked for length) or above it (certain)
        self.here: list[list[int]] = [[] for _ in self.next]
        for s in range(1, len(self.next)):
            up = s
            while up > 0:
                self.here[s] += [p for p, (state, _) in enumerate(self.phrases) if state == up]
                up = self.link[up]

    def _new(self, length: int, link: int, moves: dict[str, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.places.append({})
        return len(self.next) - 1

    def _extend(self, last: int, w: str) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        cur, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: str, q: int) -> int:
        c = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def scan(self, words: list[str], min_run: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """(phrase, start) of every place of a phrase, and (start, length, state) of maximal runs."""
        nexts, link, length, here, phrases = self.next, self.link, self.length, self.here, self.phrases
        found, runs = [], []
        state = run = 0
        known = nexts[0]
        for i, w in enumerate(words):
            if w not in known:  # no template has this word at all
                if run >= min_run:
                    runs.append((i - run, run, state))
                state = run = 0
                continue
            to = nexts[state].get(w)
            if to is None:
                if run >= min_run:
                    runs.append((i - run, run, state))
                while to is None:
                    state = link[state]
                    to = nexts[state].get(w)
                run = length[state]
            state, run = to, run + 1
            if here[state]:
                for p in here[state]:
                    n = phrases[p][1]
                    if run >= n:
                        found.append((p, i - n + 1))
        if run >= min_run:
            runs.append((len(words) - run, run, state))
        return found, runs


class Scanner:
    def __init__(self, base: tuple = BASE, templates: tuple = TEMPLATES):
        self.base = base
        self.labels = [b[1] for b in base] + [t[0] for t in templates]
        self.words = [words_of(x) for x in [b[0] for b in base] + [t[1] for t in templates]]
        self.automaton = Automaton(self.words, self.words[: len(base)])
        self.n_base = len(base)

    def spans(self, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """(first word, last word, label, share of the template) of chains of runs that cover enough."""
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        for start, n, state in runs:
            for t, ends in self.automaton.places[state].items():
                if t >= self.n_base:
                    anchors.setdefault(t, []).extend((start, e - n + 1, n) for e in ends)
        out = []
        for t, mine in anchors.items():
            size = len(self.words[t])
            # best chain that ends in each anchor: words covered, and where it began
            chains: list[tuple[int, int, int, int, int]] = []
            for x, y, n in sorted(mine):
                covered, began, before = n, x, None
                for k in range(len(chains) - 1, -1, -1):
                    px, py, pc, pb, _ = chains[k]
                    if x - px > MAX_GAP + 1 + size:
                        break
                    if px < x <= px + MAX_GAP + 1 and py < y <= py + MAX_GAP + 1 and pc + n > covered:
                        covered, began, before = pc + n, pb, k
                if before is not None:
                    chains[before] = (*chains[before][:4], 1)
                chains.append((x + n - 1, y + n - 1, covered, began, 0))
            for end, _, covered, began, gone_on in chains:
                if not gone_on and (covered >= MIN_COVER * size or covered >= MIN_WORDS):
                    out.append((began, end, self.labels[t], min(1.0, covered / size)))
        return sorted(out)

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        places, runs = self.automaton.scan(words, MIN_RUN)
        spans = self.spans(runs)
        starts = [s for _, s in places]
        base = {self.labels[p] for p, _ in places}
        score = 1.0 if places else max((s[3] for s in spans), default=0.0)
        return {
            "n_words": len(words), "n_base": len(places),
            "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s[2] for s in spans})),
            "score": score, "spans": spans,
        }


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base: tuple = BASE, templates: tuple = TEMPLATES) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (first and
    last word, label and covered share) of every row."""
    span = "array<struct<first_word: bigint, last_word: bigint, label: string, share: double>>"
    ddl = f"n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {span}"
    schema = StructType([StructField(key, docs.schema[key].dataType), *StructType.fromDDL(ddl)])
    kinds = {
        "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
        "spans": pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("share", pa.float64())])),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, templates)
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
            for r in rows:
                r["spans"] = [dict(zip(("first_word", "last_word", "label", "share"), s)) for s in r["spans"]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[n] for r in rows], k) for n, k in kinds.items()]], names=[key, *kinds]
            )

    return docs.select(key, text).mapInArrow(run, schema)
