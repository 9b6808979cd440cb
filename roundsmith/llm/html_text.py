"""Main text of web pages by line-block distribution.

1. Markup is stripped: scripts, styles and comments go, as do elements that never hold article text (menus,
   headers, footers, forms ... by tag, role, or a class or id that says nothing else).  What is left is cut
   into block lines in page order.
2. A line weighs its length; a line that is mostly link text weighs nothing unless it is a paragraph of prose.
   Weights are summed over sliding windows of ``window`` lines.
3. Where the sum surges over the threshold, ``surge`` characters or, on a page without
   article text by markup, half of the largest sum if that is less, a text region starts, at the window's first line that is prose, a heading or long itself.  The region dives where
   all lines of a window are thin: short, no prose, and summing to less than the threshold.  Text between
   surge and dive is kept, and nothing is left out of it; short lines outside any region, such as menus without markup, go.

Lines in article or main elements are the page's own word for its text and always belong to a region;
a list or table that follows prose goes on with it.

Cases: a null or empty page, or one without text, has the empty text; unclosed and stray tags, quotes and
comments are tolerated; repeated rows give repeated results; an empty table gives no rows; further
columns are ignored.  A page of any length, and of any depth, is read once, in linear time.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundsmith.llm.words import slices

#: Fixed values of HTML: elements whose content is no page text (the first of them even when unclosed), elements without content, and block elements.
RAW_TO_END = frozenset("script style textarea title".split())
RAW = RAW_TO_END | frozenset("noscript template iframe svg math object select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold prose, and those whose lines go on with the prose before them.
PROSE = frozenset("p blockquote pre".split())
GOING_ON = PROSE | HEADINGS | frozenset("li dd dt td th caption figcaption summary".split())
#: Elements and ARIA roles that never hold article text, and class or id words that say so.
OUTSIDE = frozenset("nav footer aside form menu button dialog input label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
BOILER = frozenset(
    "ad adbox ads adsbygoogle adsense adslot advert advertisement advertising advertorial adverts breadcrumb breadcrumbs comment commentbox commentform commentlist comments consent cookie cookiebanner cookiebar cookies copyright disclaimer discussion disqus feedback footer gdpr leaderboard leftbar login mainnav masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination paywall popup promo promos promoted promotion reactions related replies reply respond responses rightbar search searchbox searchform share sharing sidebar sidebars sidenav signup skip social sponsor sponsored subnav subscribe subscription teaser teasers toolbar topbar topnav usercomments widget widgets".split()
)
#: These say so only outside an article.
TOP = frozenset("alert banner header top".split())
#: Words that may stand beside them, as may any of one or two letters; a class or id with any other word says something else.
BESIDE = frozenset(
    "all also and area bar block blocks body bottom box boxes btn button buttons card cards col column container content cta desktop email first fixed follow for form frame global group holder icon icons inline inner item items last latest left like likes line link links list main message mobile module more msg news our outer page panel policy popular primary read recent recommended region right row rows secondary section sections see site slot small sticky text the this thread title tools top trending unit user view wrap wrapper you your zone".split()
)
ARTICLES = frozenset("article articles entry post posts reader readers stories story".split())

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*+")
#: A quote counts after an equals sign only; one that is never closed doesn't count.
_TAG_END = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'<>]++)))?""")
_NAMED = frozenset("class id role hidden aria-hidden style".split())
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LETTERS = re.compile(r"[A-Za-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")


class Line(NamedTuple):
    text: str
    weight: int
    prose: bool
    heading: bool
    going_on: bool
    article: bool


def says_boiler(value: str, in_article: bool) -> bool:
    """Whether one of a class or id attribute's names says that the element is no article text, and nothing else."""
    for name in value.split():
        words = {w.lower() for w in _LETTERS.findall(_CAMEL.sub(" ", name)) if len(w) > 2 or w.lower() in BOILER}
        if words & BOILER and words <= BOILER | TOP | BESIDE | ARTICLES:
            return True
        if not in_article and words & TOP and words <= TOP | BESIDE - {"page"}:
            return True
    return False


def _outside(name: str, attributes: str, in_article: bool) -> bool:
    if name in OUTSIDE:
        return True
    if name == "header" and not in_article:
        return True
    for m in _ATTRIBUTE.finditer(attributes) if attributes and not attributes.isspace() else ():
        key = m[1].lower()
        if key not in _NAMED:
            continue
        value = m[2] or m[3] or m[4] or ""
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and _HIDDEN.search(value):
            return True
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and says_boiler(value, in_article):
            return True
    return False


def pieces(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before the tag, tag name, whether it closes, attributes); the name of the rest is empty."""
    at, begin, last, quotes = 0, 0, page.rfind(">"), True
    absent: set[str] = set()
    text: list[str] = []
    while True:
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            break
        if page.startswith("<!", lt) or page.startswith("<?", lt):
            text.append(page[begin:lt])
            stop = ("-->", lt + 2) if page.startswith("<!--", lt) else ("]]>", lt) if page.startswith("<![CDATA[", lt) else (">", lt)
            end = page.find(*stop)
            at = begin = end + len(stop[0]) if end >= 0 else len(page)
            continue
        closing = page.startswith("/", lt + 1)
        name = _NAME.match(page, lt + 1 + closing)
        if name is None:
            at = lt + 1  # a sign, no tag
            continue
        found = _TAG_END.match(page, name.end()) if quotes else None
        if found:
            end = found.end()
        else:
            # No closing sign outside quotes from here on, so quotes can't be trusted.
            quotes, end = False, page.find(">", name.end()) + 1
        text.append(page[begin:lt])
        kind, attributes = name[0].lower(), page[name.end():end - 1]
        yield "".join(text), kind, closing, attributes
        text.clear()
        at = begin = end
        if kind in RAW and not closing and not attributes.endswith("/") and kind not in absent:
            close = re.compile(rf"</{kind}(?=[\s/>])", re.IGNORECASE).search(page, end)
            if close:
                at = begin = close.start()
            elif kind in RAW_TO_END:
                at = begin = len(page)
            else:
                absent.add(kind)
    yield "".join([*text, page[begin:]]), "", False, ""


def lines(page: str) -> list[Line]:
    """The block lines in page order, without those outside."""
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements that matter, and whether they stand outside
    depth: Counter[str] = Counter()
    linked = outside = links = 0

    def close_line() -> None:
        nonlocal linked
        if parts and not outside:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                kind = stack[-1][0] if stack else ""
                by_links = 2 * linked > len(text)
                sentence = _SENTENCE.search(text) is not None and text.count(" ") >= 2
                prose = sentence and (kind in PROSE or not by_links) or kind in PROSE and not by_links
                article = depth["article"] + depth["main"] > 0
                out.append(Line(text, len(text) if article or prose or not by_links else 0, prose, kind in HEADINGS, kind in GOING_ON and not by_links, article))
        parts.clear()
        linked = 0

    def close_element() -> None:
        nonlocal outside
        name, is_out = stack.pop()
        depth[name] -= 1
        outside -= is_out

    for data, name, closing, attributes in pieces(page):
        if data:
            parts.append(data)
            if links:
                linked += len(data.strip())
        if name == "br" or not name:
            parts.append(" ")
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        block = name in BLOCKS
        if block:
            close_line()
        if closing:
            if depth[name] > 0:
                while stack[-1][0] != name:
                    if stack[-1][1]:
                        close_line()
                    close_element()
                if stack[-1][1]:
                    close_line()
                close_element()
            continue
        if name in VOID or attributes.endswith("/") and not block:
            continue
        if name in ("p", "li", "dd", "dt", "tr", "td", "th") and stack and stack[-1][0] == name:
            close_element()  # these end an open element of their own kind
        is_out = _outside(name, attributes, depth["article"] + depth["main"] > 0)
        if is_out and not block:
            close_line()
        if block or is_out:
            stack.append((name, is_out))
            depth[name] += 1
            outside += is_out
    close_line()
    return out


def regions(found: list[Line], window: int, surge: int) -> list[tuple[int, int]]:
    """(surge, dive) of every text region."""
    n = len(found)
    total = [0]
    for line in found:
        total.append(total[-1] + line.weight)
    sums = [total[min(n, i + window)] - total[i] for i in range(n)]
    threshold = surge if any(line.article for line in found) else min(surge, max(sums, default=0) / 2)
    out, i = [], 0
    while i < n:
        if not found[i].article and sums[i] <= threshold:
            i += 1
            continue
        # The surge: the window's first line that can begin a text.
        begins = (j for j in range(i, min(n, i + window)) if found[j].article or found[j].prose or found[j].heading or found[j].weight * window > threshold)
        begin = next(begins, i)
        # The dive: a whole window of thin lines, and all of its headings belong to what follows.
        last, j = begin, begin + 1
        while j < n and j - last <= window:
            line = found[j]
            if line.article or line.prose or line.going_on and not line.heading or line.weight * window > threshold and not line.heading:
                last = j
            j += 1
        out.append((begin, last + 1))
        i = last + 1
    return out


def main_text(page: str | None, window: int = 3, surge: int = 80) -> str:
    """The page's article, one line per block."""
    if not page:
        return ""
    found = lines(page)
    return "\n".join(found[i].text for a, b in regions(found, window, surge) for i in range(a, b))


def extract(pages: DataFrame, window: int = 3, surge: int = 80) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            text = [main_text(h, window, surge) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
