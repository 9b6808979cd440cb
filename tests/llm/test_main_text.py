"""Line-block extraction: regions against a plain restatement of the rule, and pages that markup alone doesn't settle."""

import random
import time

import pytest

from roundsmith.llm import html_text
from roundsmith.llm.html_text import Line, main_text, regions

PROSE = "Long prose of the article goes on here and on, with many words that tell a story about something."
P = f"<p>{PROSE}</p>"
MENU = "".join(f"<div>Menu {i}</div>" for i in range(30))


@pytest.mark.parametrize(
    "page,text",
    [
        (P * 20 + '<div class="ad">Buy</div>' * 4 + "<p>It closed on Monday.</p><footer>c</footer>", [PROSE] * 20 + ["It closed on Monday."]),
        (P + "<p><a href=x>A linked title of a book that is long</a> is by Ann.</p>" + P, [PROSE, "A linked title of a book that is long is by Ann.", PROSE]),
        (f'<div class="related-work">{P}{P}</div>', [PROSE, PROSE]),
        (f'<div class="related-posts">{P}</div><p title="hidden gem">{PROSE}</p>', [PROSE]),
        (MENU + "<h1>Title</h1>" + P + P + MENU, ["Title", PROSE, PROSE]),
        ("<ul>" + "<li><a href=/>Home page</a></li>" * 9 + "</ul>" + P + "<ul><li>Flour</li><li>Eggs</li><li>Milk</li><li>Salt</li></ul>" + P, [PROSE, "Flour", "Eggs", "Milk", "Salt", PROSE]),
        (f"{MENU}<article>Short.<p>Two</p></article>{MENU}", ["Short.", "Two"]),
        ("<p>Only &#228; <i>text", ["Only ä text"]),
        ("<nav><a>m</a></nav>", []),
        (f'<p>a < b and b > c.</p><div id="sidebar-2">{P}</div><svg>x</svg><noscript>{P}</noscript><!-- {P} --><p>End', ["a < b and b > c.", "End"]),
        (f'<p class="x" title="a > b">{PROSE}</p><p title="open>{PROSE}</p>', [PROSE, PROSE]),
        (None, []),
        ("", []),
    ],
)
def test_pages(page, text):
    assert main_text(page).split("\n") == (text or [""])


@pytest.mark.parametrize(
    "name,outside,inside",
    [("wp-comments", True, True), ("related-posts", True, True), ("related-work", False, False), ("siteFooter", True, True), ("site-header", True, False), ("post-header", False, False), ("my-ads", True, True), ("adventure", False, False), ("x related-work cookie_notice", True, True), ("", False, False)],
)
def test_names_that_say_boilerplate_and_nothing_else(name, outside, inside):
    assert (html_text.says_boiler(name, False), html_text.says_boiler(name, True)) == (outside, inside)


def test_regions_equal_the_rule_restated():
    rng = random.Random(4)
    for _ in range(2000):
        found = []
        for _ in range(rng.randrange(0, 25)):
            kind = rng.random()
            size = rng.choice([0, 3, 8, 20, 40, 200])
            found.append(Line("x", size, kind < 0.2, 0.2 <= kind < 0.3, kind < 0.4, kind > 0.95))
        window, surge = rng.choice([1, 2, 3, 5]), rng.choice([10, 80])
        sums = [sum(x.weight for x in found[i:i + window]) for i in range(len(found))]
        least = surge if any(x.article for x in found) else min(surge, max(sums, default=0) / 2)
        strong = [x.article or x.prose or not x.heading and (x.going_on or x.weight * window > least) for x in found]
        can_begin = [x.article or x.prose or x.heading or x.weight * window > least for x in found]
        kept, i = [], 0
        while i < len(found):
            if found[i].article or sums[i] > least:
                begin = min([j for j in range(i, min(len(found), i + window)) if can_begin[j]] or [i])
                end = begin
                while any(strong[end + 1:end + 1 + window]):
                    end += 1 + strong[end + 1:].index(True)
                kept.append((begin, end + 1))
                i = end + 1
            else:
                i += 1
        assert regions(found, window, surge) == kept


@pytest.mark.parametrize("page", ["<a " * 330_000, '<a title="' * 100_000 + ">", '<a x=">"' * 100_000, "<div>" * 200_000 + "x", "<div>" * 100_000 + "</p>x" * 100_000, "<script " * 100_000 + ">", "<svg>" * 100_000, "<!" * 300_000, "&#38;" * 200_000, "<p>" * 200_000 + "</div>" * 10])
def test_long_and_broken_pages_take_linear_time(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 3


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, text int")
    assert html_text.extract(pages).count() == 0
