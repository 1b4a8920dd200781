"""Pages that never end, and texts by others that outweigh the article."""

import random
import time

import pytest

from edge import documents
from farewise.llm.html import INLINE, extract_main_text, main_text, parse

ARTICLE = "<p>The article is here, one paragraph of it, not long at all.</p>"
LONG = "<p>A reader writes a long remark about the article, much longer than it.</p>" * 8


@pytest.mark.parametrize("name", ["comments", "comment-list", "adverts", "ad-box", "cookie-notice", "notices", "notice"])
def test_texts_by_others_stay_out_at_any_length(name):
    page = f"<body><div class='content'>{ARTICLE}</div><div class='{name}'>{LONG}</div></body>"
    assert main_text(page) == "The article is here, one paragraph of it, not long at all."


@pytest.mark.parametrize("page", [
    "<div>" * 40_000, "<p>" * 60_000, "<b>" * 60_000, "<li>x" * 40_000, '<a title="' * 30_000, '<a title="' * 30_001 + ">", "<a b='>" * 30_001,
    "<div>" * 20_000 + "</section>" * 20_000, "<div>" * 20_000 + "</b>" * 20_000, "<table><tr><td>" * 15_000, "<" * 300_000, "<!--" * 50_000,
    "<article>" * 20_000 + "<p>x</p>" * 20_000,
])
def test_hostile_pages_end_soon(page):
    """Work grows with the page, not with its square: twice the page takes about twice as long."""
    times = []
    for part in (page, page * 2):
        start = time.process_time()
        main_text(part)
        times.append(time.process_time() - start)
    assert times[1] <= 3 * times[0] + 0.5


@pytest.mark.parametrize(("html", "text"), [
    ("a < b and c <i", "a < b and c"), ("x <!-- y", "x"), ("x > y < 3 </p", "x > y < 3"), ("<p>t</p>1 < 2 <a href='", "t\n1 < 2"), ("a <? b", "a"),
])
def test_unfinished_tags_at_the_end(html, text):
    assert main_text(html) == text


def _open_tags(html_tags):
    """The stack rules one tag at a time, walking the open elements."""
    tags = ["#root"]
    for tag, ends in html_tags:
        if ends:
            d = len(tags) - 1
            while d > 0 and tags[d] != tag:
                if tag in INLINE and tags[d] not in INLINE:
                    d = 0
                    break
                d -= 1
            if d > 0:
                del tags[d:]
        else:
            tags.append(tag)
    return tags


def test_end_tags_close_what_walking_the_stack_would(spark):
    rnd = random.Random(2)
    for _ in range(300):
        seq = [(rnd.choice(["div", "section", "b", "i", "span", "article"]), rnd.random() < 0.45) for _ in range(40)]
        page = "".join(f"<{'/' if e else ''}{t}>" for t, e in seq) + "<main>x"
        _, blocks, _ = parse(page)
        up, n = [], blocks[0][0].parent
        while n is not None:
            up.append(n.tag)
            n = n.parent
        assert up[::-1] == [t for t in _open_tags(seq) if t not in INLINE]


def test_repeated_pages_and_ties(spark):
    page = "<div><p>one and two</p></div><div><p>six and ten</p></div>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, HTML string")
    got = sorted((tuple(r) for r in extract_main_text(pages).collect()), key=str)
    assert got == sorted([(i, u, main_text(h), len(main_text(h))) for i, u, h in rows], key=str)
    assert documents(spark, []).count() == 0
