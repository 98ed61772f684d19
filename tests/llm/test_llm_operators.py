"""The corpus operators against brute force, and on nulls, empty texts and tables, ties and clashing columns."""

import collections
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.llm import grouplinks, htmltext, licenses, linededup, mixing, ngramjoin, packing, pii, quality, queries, topk, urlfilter

SF = "/root/testdata/sf0.001"
BLANK = r"[^\x20\x09-\x0D]+"
ODD = [(-1, None), (-2, ""), (-3, " \n\t"), (-4, "one"), (None, "a null id"), (-5, "x " * 30_000), (-6, "same"), (-6, "same")]


def docs(spark, rows=None):
    rows = ODD if rows is None else rows
    df = spark.createDataFrame([(i, t, "en", "src1") for i, t in rows], "doc_id long, text string, lang string, source string")
    # columns whose names clash with those that the operators make
    return df.withColumn("n", F.lit("clash")).withColumn("size", F.lit("clash")).withColumn("removed", F.lit("clash")).withColumn("badness", F.lit("clash"))


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# -- licences


def test_license_places_match_a_scan(spark):
    rows = ODD + [(1, "The MIT License. mit license"), (2, "GNU General Public LICENSE, apache License; general public licence")]
    out = {(r.doc_id, r.n_words): r for r in licenses.scan(docs(spark, rows)).collect()}
    assert len(out) == len(rows) - 1  # two rows are alike
    for (i, _), r in out.items():
        text = next(t for k, t in rows if k == i)
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
        places = sorted((j, label) for p, label in licenses.BASE for j in range(len(words)) if words[j : j + len(p.split())] == p.split())
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def test_automaton_finds_longest_runs():
    rng = random.Random(1)
    templates = [[rng.choice("abc") for _ in range(12)] for _ in range(3)]
    auto = licenses.Automaton(templates, [t[:2] for t in templates])
    grams = {tuple(t[i:j]) for t in templates for i in range(12) for j in range(i + 1, 13)}
    words = [rng.choice("abcd") for _ in range(400)]
    found, runs = auto.scan(words, 1)
    for p, t in enumerate(templates):
        want = [i for i in range(len(words)) if words[i : i + 2] == t[:2]]
        assert sorted(i for q, i in found if q == p) == want
    for start, n, _ in runs:
        assert tuple(words[start : start + n]) in grams
        assert start + n == len(words) or tuple(words[start : start + n + 1]) not in grams


def test_license_template_is_chained_over_a_change():
    words = licenses.TEMPLATES[0][1].split()
    changed = " ".join(words[:20] + ["newword"] + words[21:])
    assert "mit" in licenses.Scanner().scan(changed)["labels"]


# -- top-k


def test_top_k_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(60)] + [(100 + i, [0.5] * 6) for i in range(8)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [1.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk.top_k(df.where("vec_id % 10 = 0"), df, 5).collect()
    usable = {i: np.floor(256 * np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for q in [i for i in usable if i % 10 == 0]:
        best = sorted(((-int(usable[q] @ v), i) for i, v in usable.items() if i != q and len(v) == len(usable[q])))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == sorted(want)
    assert topk.top_k(df.limit(0), df, 5).count() == 0


# -- mixing


def water(sizes, weights, cap=2):
    total, target, open_ = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        rest = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        over = [i for i in open_ if rest * weights[i] / sum(weights[j] for j in open_) > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = rest * weights[i] / sum(weights[j] for j in open_)
            break
        for i in over:
            target[i] = cap * sizes[i]
            open_.discard(i)
    return target


def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 60), f"s{rng.choice([0, 0, 0, 1, 2, 3])}") for i in range(400)] + [(1000, "w " * 500, None), (1001, None, "s9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).toPandas()
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = [sum(len(re.findall(BLANK, t or "")) for _, t, s in rows if s == n) for n in names]
    want = dict(zip(names, water(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))])))
    again = mixing.mix(df).toPandas()
    for name, size in zip(names, sizes):
        own = out[out.source.isna()] if name is None else out[out.source == name]
        assert (own.source_size == size).all() and np.allclose(own.target, want[name])
        assert own.taken.sum() == int(want[name] + 1e-9)
        assert (own.taken <= 2 * own["size"]).all()
    assert out.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert mixing.mix(df.limit(0)).count() == 0


def test_repeat_meets_targets_without_shuffling_texts(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 60), f"s{rng.choice([0, 0, 0, 1, 2])}", "clash") for i in range(300)] + [(None, "a b", None, "x"), (None, "a b", None, "y"), (900, None, "s9", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    shares = {r.source: r for r in mixing.mix(df.drop("size")).collect()}
    out = mixing.repeat(df)
    assert out.columns == df.columns and mixing.repeat(df.limit(0)).count() == 0
    got = collections.Counter()
    for r in out.collect():
        got[r.source] += len((r.text or "").split())
    for name, r in shares.items():
        assert abs(got[name] - r.target) <= 2
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == collections.Counter((r.doc_id, r.text) for r in mixing.repeat(df.repartition(7)).collect())


# -- n-gram join


def brute_classes(rows):
    def shingles(t):
        w = re.findall(BLANK, lower(t))
        return frozenset() if not w else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)])

    sets = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            at[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            groups[find(i)].append(k)
    return [(k, len(sets[i]), min(groups[find(i)], default=None) if sets[i] else k) for i, (k, _) in enumerate(rows)]


def test_ngram_classes_match_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = list(ODD)
    for i in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 6)):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.join(docs(spark, rows)).collect()), key=key)
    assert got == sorted(brute_classes(rows), key=key)
    kept = {r.doc_id for r in ngramjoin.keep_one(docs(spark, rows)).collect()}
    assert kept == {k for k, _, c in brute_classes(rows) if k == c or k is None}
    assert ngramjoin.join(docs(spark, [(1, "a")]).limit(0)).count() == 0


def test_trie_walk_matches_overlaps():
    rng = np.random.default_rng(3)
    for _ in range(30):
        base = np.unique(rng.integers(0, 400, 60, dtype=np.uint64))
        some = [np.unique(np.concatenate([rng.choice(base, len(base) - k, replace=False), rng.integers(400, 900, k, dtype=np.uint64)])) for k in rng.integers(0, 30, 25)]
        some += [base, base[:1], base[:40]]
        want = [100 * len(np.intersect1d(base, s)) >= 75 * len(np.union1d(base, s)) for s in some]
        assert ngramjoin.links_in_trie(base, some) == want and True in want and False in want


def test_parity_bound_never_exceeds_the_difference():
    rng = np.random.default_rng(5)
    for n in (10, 300, 2000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 2**63, n // 8, dtype=np.uint64)]))
        x, y = (np.array(ngramjoin._parity(s), np.int64).view(np.uint64) for s in (a, b))
        while len(x) != len(y):
            x, y = (x[: len(x) // 2] ^ x[len(x) // 2 :], y) if len(x) > len(y) else (x, y[: len(y) // 2] ^ y[len(y) // 2 :])
        assert sum(int(v).bit_count() for v in x ^ y) <= len(np.setxor1d(a, b))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(40)] + [(7, 7)]
    got = {r.id: r.comp for r in grouplinks.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(set(got.values())) == 2 and len({got[i] for i in range(51)}) == 1


# -- HTML


def test_html_keeps_the_article():
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
    <div class="cookie-notice"><p>We use cookies on this site, which you may accept or not, as you like.</p></div>
    <article><h1>Head</h1><p>First &amp; long enough paragraph of the text, with a stop.<p>Second<br>line &eacute;</p><aside>Not this, although it is a full sentence.</aside></article>
    <section id="comments"><p>I liked this article a lot, and wrote so at some length here.</p></section><form><label>Name</label></form><footer>&copy; x</footer>"""
    assert htmltext.main_text(page) == "Head\nFirst & long enough paragraph of the text, with a stop.\nSecond line é"


@pytest.mark.parametrize("page", [None, "", "<p", "<", "plain", "<article><p>cut &am", "<script>x", "<!-- x"])
def test_html_reads_broken_pages(page):
    assert isinstance(htmltext.main_text(page), str)


LONG = "This is a paragraph of the article that is long enough to say something of its own accord."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div class="content no-sidebar"><p>{LONG}</p></div>', LONG),
        (f'<body><form action="/"><p>{LONG}</p><p>{LONG}</p></form></body>', f"{LONG}\n{LONG}"),
        (f'<article class="post share-enabled"><p>{LONG}</p></article>', LONG),
        ("<div>Hello there</div>", "Hello there"),
        (f"<article><p><b title=don't>{LONG}</b></p></article>", LONG),
        (f'<article><p><a href="x>{LONG}</p></article>', LONG),
    ],
)
def test_html_names_do_not_veto_and_stray_quotes_are_no_text(page, want):
    assert htmltext.main_text(page) == want


def test_html_cut_differs_from_the_signs_of_single_blocks():
    page = f"<div><p>{LONG}</p><div>and so</div><p>{LONG}</p></div><nav>Menu</nav><article></article>"
    blocks = htmltext.blocks_of(page)
    kept = htmltext.content(blocks)
    signs = [b.odds(False) > 0 for b in blocks]
    assert [b.text for b in kept] == [LONG, "and so", LONG] and signs == [True, False, True, False]


def test_html_rows(spark):
    rows = [(1, "u", "<p>" + LONG), (1, "u", "<p>" + LONG), (None, None, LONG), (2, "v", None), (3, "w", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    out = htmltext.extract(df)
    got = collections.Counter((r.page_id, r.url, r.text, r.n_chars) for r in out.collect())
    assert got == collections.Counter((i, u, LONG if h else "", len(LONG) if h else 0) for i, u, h in rows)
    assert htmltext.extract(df.limit(0)).count() == 0


def test_flow_is_a_minimum_cut():
    rng = random.Random(6)
    for _ in range(40):
        n = 6
        ties = [(a, b, rng.randrange(0, 9)) for a, b in itertools.combinations(range(n), 2)]
        ends = [(rng.randrange(0, 20), rng.randrange(0, 20)) for _ in range(n)]
        flow = htmltext.Flow(n + 2)
        for i, (s, t) in enumerate(ends):
            flow.tie(n, i, s)
            flow.tie(i, n + 1, t)
        for a, b, c in ties:
            flow.tie(a, b, c, c)
        side = flow.source_side(n, n + 1)[:n]
        cost = lambda x: sum(t if x[i] else s for i, (s, t) in enumerate(ends)) + sum(c for a, b, c in ties if x[a] != x[b])
        assert cost(side) == min(cost(x) for x in itertools.product([False, True], repeat=n))


# -- URLs


def test_cascade_is_exact_on_its_universe(spark):
    keys = [(f"h{i}.example", i % 7 == 0) for i in range(3000)]
    df = spark.createDataFrame(keys, "host string, on boolean")
    cascade = urlfilter.Cascade.build(df, "host", "on")
    assert len(cascade.levels[0]) > 1
    assert cascade.mark(df, "host", "got").where("got <> on").count() == 0


def test_url_rules(spark):
    urls = ["https://A.example.com/en/1?x", "http://www.example.com/en/", "https://x.net/es/#a", "https://x.net", None, "no scheme", "ftp://casino-win.example.org/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, queries.URL_RULES, queries.listed_hosts(df)).collect()}
    assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block") and got[1][2:] == ("www.example.com/en/", "allow")
    assert got[2][2:] == ("net/es/", "block") and got[3] == ("x.net", "", None, "allow")
    assert got[4] == got[5] == ("", "", None, "allow") and got[6][3] == "block"


def test_url_filter_is_exact_on_a_random_list(spark):
    rng = random.Random(12)
    hosts = [f"h{i}.org" for i in range(500)]
    listed = set(rng.sample(hosts, 60))
    urls = [f"https://{rng.choice(hosts)}/{'x' * (100_000 if i == 0 else 5)}" for i in range(2000)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[:9])], "page_id long, url string")
    some = spark.createDataFrame([(h,) for h in [*listed, "other.org", *listed]], "host string")
    out = urlfilter.judge(df, [], some)
    for r in out.collect():
        assert r.verdict == ("block" if r.host in listed else "allow")
    assert out.count() == 2009 and urlfilter.judge(df.limit(0), [], some).count() == 0 and urlfilter.judge(df, [], some.limit(0)).where("verdict = 'block'").count() == 0


# -- PII


def test_surrogates(spark):
    rows = ODD + [(1, "Mail Bo.Li@mail.org, bo.li@mail.org; call +1 (337) 555-7349, +1 337 555 7349; 10.2.3.4"), (2, "bo.li@mail.org card 4952935900253052 token " + "0af1" * 10), (3, "Mrs. Anna Smith")]
    out = {r.doc_id: r for r in pii.replace(docs(spark, rows), secret="s").collect()}
    assert out[-1].text is None and out[-2].text == "" and out[-5].text == "x " * 30_000 and out[-4].n_entities == 0
    for secret in ("bo.li", "Bo.Li", "555-7349", "10.2.3.4", "4952935900253052", "0af10af1", "Smith"):
        assert secret not in " ".join(r.text or "" for r in out.values())
    mails = re.findall(r"\S+@[\w.]+\w", out[1].text + " " + out[2].text)
    assert len({m.lower() for m in mails}) == 1
    phones = re.findall(r"\+1[ ()\d-]+\d", out[1].text)
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[1].text)
    card = [int(c) for c in reversed(re.search(r"\d{16}", out[2].text)[0])]
    assert sum(c if i % 2 == 0 else sum(divmod(2 * c, 10)) for i, c in enumerate(card)) % 10 == 0
    assert out[3].text.startswith("Mrs. ") and out[3].text.split()[1].endswith("na")


def test_surrogates_of_long_tokens_telephones_and_numbers(spark):
    rows = [(1, "a" * 1_000_000), (2, "x@" + "a." * 20_000 + "com"), (3, "call (337) 555-7349 or +1 337 555 7349"), (4, "order 4952935900253 stays"), (4, "order 4952935900253 stays")]
    began = time.time()
    out = pii.replace(docs(spark, rows), secret="s").collect()
    assert time.time() - began < 60 and len(out) == 5
    got = {r.doc_id: r for r in out}
    assert got[1].text == rows[0][1] and got[4].text == rows[3][1] and got[4].n_entities == 0
    first, second = re.findall(r"\(?\d{3}\)?[ -]\d{3}[- ]\d{4}", got[3].text)
    assert re.sub(r"\D", "", first) == re.sub(r"\D", "", second) != "3375557349" and "+1 " in got[3].text
    assert pii.replace(docs(spark, rows).limit(0), secret="s").count() == 0


def test_surrogates_where_a_format_is_used_up(spark):
    values = spark.createDataFrame([("phone", f"{i:03d}") for i in range(1000)], "kind string, canon string")
    got = pii.surrogates(values, "s").collect()
    assert len({r.surrogate for r in got}) == 1000 and not {r.surrogate for r in got} & {r.canon for r in got}


def test_surrogates_are_distinct(spark):
    values = spark.createDataFrame([("ssn", f"{i:09d}") for i in range(2000)] + [("name", f"mr x{i}") for i in range(300)], "kind string, canon string")
    got = pii.surrogates(values, "s").collect()
    assert len(got) == 2300 and len({(r.kind, r.surrogate) for r in got}) == 2300
    assert not {(r.kind, r.surrogate) for r in got} & {(r.kind, r.canon) for r in got}


# -- quality


def brute_counts(t):
    w = re.findall(BLANK, t or "")
    lines = [x for x in (t or "").split("\n") if re.search(BLANK, x)]
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    inside = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_match_brute_force(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = quality.features(docs(spark, ODD + table).select("doc_id", "text")).collect()
    assert len(out) == len(ODD) + len(table)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(r.text)


def test_upper_bound_is_exact():
    for k, n, level in ((0, 100, 0.05), (3, 50, 0.01), (40, 2000, 0.0125)):
        p = quality.upper_bound(k, n, level)
        tail = sum(__import__("math").comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(tail - level) < 1e-6
    assert quality.upper_bound(5, 5, 0.05) == 1.0 and quality.upper_bound(0, 0, 0.05) == 1.0


def test_quality_without_labels_rejects_by_base_rules_only(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.judge(docs(spark).select("doc_id", "text", "lang"), labels).collect()
    assert len(out) == len(ODD) and all(r.kept == (not r.base_failed) for r in out)


# -- packing


def test_packing_is_whole_and_gapless(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    rows = ODD + [(i, "some words and Ünïcode it's 12,5 … " * (i % 40)) for i in range(1, 80)]
    cut = packing.pieces(docs(spark, rows), path, with_ids=True)
    out = packing.pack(cut).toPandas()
    tok = Tokenizer.from_file(path)
    want = collections.Counter()
    for _, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.update((len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048))
    assert collections.Counter(zip(out.length, out.ids_crc32)) == want
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own.length.sum() <= 2048 and own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
    assert out.sequence_id.nunique() <= 1.05 * -(-out.length.sum() // 2048) + 1
    assert packing.pack(packing.pieces(docs(spark).limit(0), path)).count() == 0


def test_best_fit_holds_every_capacity():
    rng = np.random.default_rng(7)
    lengths = np.sort(rng.integers(1, 100, 400))[::-1]
    bins = packing._best_fit(lengths, np.ones(400, np.int64), lengths**2, (200, 5, 15_000))
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 200 and len(own) <= 5 and (own**2).sum() <= 15_000


# -- lines


def test_line_dedup_keeps_one_of_each_class(spark):
    rows = ODD + [(1, "Hello there my good old friend of mine\nx\n\nunique line one two three four"), (2, "hello THERE my good, old friend of mine!\nx"), (3, "alone here")]
    out = {r.doc_id: r.text for r in linededup.dedup(docs(spark, rows)).collect()}
    assert out[1] == rows[len(ODD)][1] and 2 not in out and out[3] == "alone here" and out[-1] is None and out[-2] == ""


@pytest.mark.parametrize("n", [5, 10, 20, 50, 200])
def test_fuzzy_lines_are_found_at_the_very_bound(spark, n):
    rng = random.Random(n)
    rows = []
    for i in range(100):
        base = [f"w{rng.randrange(4000)}" for _ in range(n)]
        own = list(base)
        for at in rng.sample(range(n), n // 5):
            own[at] = f"new{rng.randrange(10**6)}"
        assert 5 * word_distance(base, own) <= n
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(own))]
    kept = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert (200 - kept) / 100 >= 0.9


def test_line_dedup_keeps_clashing_columns_and_takes_empty_tables(spark):
    rows = [(1, "one two three four five six", "a", 7), (2, "one two three four five six seven", "b", 8), (3, "other\nother", "c", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _t string, _gone long")
    out = linededup.dedup(df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [rows[0], (3, "other", "c", 9)]
    assert linededup.dedup(df.limit(0)).count() == 0 and linededup.removals(df.limit(0)).count() == 0


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_links_of_short_lines_match_edit_distance(spark):
    rng = random.Random(11)
    rows = []
    for n in [5, 6, 9, 10, 13, 14, 19, 27, 40] * 4:
        base = [f"w{rng.randrange(60)}" for _ in range(n)]
        rows.append(base)
        for _ in range(5):
            own = list(base)
            for _ in range(rng.randrange(1, n // 4 + 2)):
                at, kind = rng.randrange(len(own)), rng.randrange(3)
                own[at : at + (kind != 1)] = [f"w{rng.randrange(60)}"] if kind < 2 else []
            rows.append(own)
    rows += [["aa", "bb"] * 4, ["aa", "bb"] * 3 + ["bb", "aa"], ["aa"] * 5, ["aa"] * 6, ["front"] + rows[40], ["front"] + rows[200]]
    at = list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = rows[i], rows[j]
        longest = max(len(a), len(b))
        if a == b or min(len(a), len(b)) >= 4 and 5 * word_distance(a, b) <= longest:
            at[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    kept = {r.doc_id for r in linededup.dedup(df).collect()}
    assert kept == {i for i in at if find(i) == i}
    assert len(kept) < len(rows) / 2


def test_keep_one_decides_by_row_where_ids_repeat(spark):
    near, other = " ".join(f"near{i}" for i in range(60)), " ".join(f"other{i}" for i in range(60))
    rows = [(1, near), (5, near + " end"), (5, other), (7, near), (8, "same words again"), (8, "same words again"), (None, near), (9, None), (9, None)]
    kept = ngramjoin.keep_one(docs(spark, rows)).collect()
    want = [(1, near), (5, other), (8, "same words again"), (None, near), (9, None), (9, None)]
    assert collections.Counter((r.doc_id, r.text) for r in kept) == collections.Counter(want)
