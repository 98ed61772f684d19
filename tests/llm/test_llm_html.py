"""HTML extraction: parts of an article and parts beside it, deep nesting, and what the cut adds to single signs."""

import random
import time

import pytest

from evigraph.llm import htmltext

LONG = "This is a paragraph of the article that is long enough to say something of its own accord."
OTHER = "Another long sentence stands here, which is not of the article and has to go from the text."


@pytest.mark.parametrize(
    "aside",
    ['<div class="advert">{}</div>', '<p class="ad">{}</p>', '<div class="notice">{}</div>', '<div class="notice"><p>{}</p></div>', "<aside><p>{}</p></aside>", '<section id="comments"><article><p>{}</p></article></section>'],
)
@pytest.mark.parametrize("mark", ["article", "main"])
def test_asides_within_an_article_go(aside, mark):
    page = f"<{mark}><p>{LONG}</p>{aside.format(OTHER)}<p>{LONG}</p></{mark}>"
    assert htmltext.main_text(page) == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("name", ["sidebar-content", "comment-body", "footer text", "widget-text"])
def test_a_name_marks_an_article_only_as_a_whole(name):
    assert htmltext.main_text(f'<article><p>{LONG}</p><p>{LONG}</p></article><div class="{name}"><p>{OTHER}</p></div>') == f"{LONG}\n{LONG}"


@pytest.mark.parametrize(
    ("part", "want"),
    [
        ("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>", "So x=2 holds."),
        ('<ul><li><a href="a">First source</a></li><li><a href="b">Second</a></li></ul>', "First source\nSecond"),
        (f'<section id="discussion"><h2>Discussion</h2><p>{OTHER}</p></section>', f"Discussion\n{OTHER}"),
        (f'<h2 class="notice-heading">Notice of it</h2><p>{OTHER}</p>', f"Notice of it\n{OTHER}"),
        (f'<div class="section" id="search"><p>{OTHER}</p></div>', OTHER),
    ],
)
def test_parts_of_an_article_stay(part, want):
    assert htmltext.main_text(f"<article><p>{LONG}</p>{part}<p>{LONG}</p></article>") == f"{LONG}\n{want}\n{LONG}"


def test_long_comments_are_no_article():
    page = f"<div class='content'><p>{LONG}</p></div><section id='comments'>" + f"<article><p>{OTHER}</p></article>" * 30 + "</section>"
    assert htmltext.main_text(page) == LONG


def _seconds(page):
    began = time.process_time()
    htmltext.main_text(page)
    return time.process_time() - began


@pytest.mark.parametrize("head", ["", "<p><li>"])
@pytest.mark.parametrize("tag", ["x", "ul", "div"])
def test_deep_nesting_is_linear(head, tag):
    page = lambda n: head + f"<{tag}>t " * n + LONG
    _seconds(page(500))
    assert _seconds(page(20_000)) < 5


def test_end_tags_of_nested_elements():
    assert htmltext.main_text("<article><ul><li>One<ul><li>Two</ul><li>Three</ul><p>Four</x></p></article>") == "One\nTwo\nThree\nFour"
    assert htmltext.main_text("<article><table><tr><td>a<td>b<tr><td>c</table></article>") == "a\nb\nc"


def test_the_cut_raises_the_score_over_single_signs():
    """Pages that mark no article: short lines with links between paragraphs belong to it, link bars at the ends don't."""
    rng = random.Random(3)
    right = {"cut": 0, "signs": 0}
    for _ in range(60):
        rows = []
        for _ in range(rng.randrange(4, 10)):
            rows.append((f"<p>{LONG} {rng.random()}.</p>", True))
            if rng.random() < 0.6:
                rows.append((f"<div>so <a href=x>say others</a> {rng.randrange(1000, 10000)}</div>", True))
        rows.append((f"<p>{LONG}</p>", True))
        bar = [(f"<div><a href=x>go {rng.random()}</a></div>", False) for _ in range(rng.randrange(2, 6))]
        page = "".join(r for r, _ in bar) + "<div>" + "".join(r for r, _ in rows) + "</div>" + "".join(r for r, _ in bar)
        truth = [k for _, k in [*bar, *rows, *bar]]
        blocks = htmltext.blocks_of(page)
        kept = set(map(id, htmltext.content(blocks)))
        right["cut"] += [id(b) in kept for b in blocks] == truth
        right["signs"] += [b.odds(True) > 0 for b in blocks] == truth
    assert right["cut"] == 60
    assert right["signs"] < 10
