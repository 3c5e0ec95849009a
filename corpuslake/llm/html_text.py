"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one for each block element. The weights of ``window`` lines from each one on are summed. Text
surges at the first line with a weight from which on the sum reaches ``surge``, and dives where the sum is 0, which is behind the last line with
a weight before ``window`` without. A range between surge and dive is the page's text if it holds at least ``share`` of the text of the largest
range, as articles are interrupted by adverts. A page that never surges keeps all its lines with a weight.
Lines of weight 0 within a range are left out.

Markup only weights the lines. A line weighs the length of its text. It weighs 0 if it belongs to navigation,
a header, footer, sidebar, notice, advert, form or to comments (by element, role, id or class) or is mostly link text. Where a page marks
its article (<article>, <main>), lines outside it weigh 0, and those inside it ``scale`` times their length, link text or not: there the sums surge at
a heading and some words after it. Inside an article an aside is told by its element, its role, or a class or id that
is a word for adverts, comments, menus, sidebars or subscriptions as a whole: its headers, notices, alerts and related sections are its own.
An article inside an element that counts as navigation and so on is read
where the rest of the page has no mark and never surges. A class that says what a page has or lacks
(``has-sidebar``, ``no-sidebar``) names no such element.

Character references are decoded, white space inside a block becomes one space, and
blocks are joined by an empty line. Every whole page is read and no text is cut.

Nulls and odd input: null and empty pages, and pages without text, give the empty text. Of ranges with equal text all count. Markup that
is never closed ends with the page or with the next block of the article. Repeated rows give the same
text. Other columns pass through; ``text`` and ``n_chars`` are replaced.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.I | re.S,
)
# Elements of HTML by their part in a page.
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ASIDE = frozenset("nav footer aside form menu dialog button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MARK = re.compile(r"\b(?:id|class|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?(?:[_-](?:slot|box|unit|wrapper|container))?|advert\w*|adsbygoogle|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|"
    r"sidebar|side-bar|widget|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|foot|comments?|disqus|replies|respond|share|sharing|"
    r"social|related|recommend\w*|complementary|contentinfo|search|login|pagination|pager|toolbar|skip\w*)(?:$|[\s_-])",
    re.I,
)
#: Of these the words that name an aside inside an article, too.
_INNER = re.compile(
    r"(?:ads?(?:[_-](?:slot|box|unit|wrapper|container))?|advert\w*|adsbygoogle|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|"
    r"sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|comments?|disqus|replies|sharing|social|complementary|contentinfo|pagination|pager)",
    re.I,
)


#: Class words that say something about an element (has-sidebar) instead of naming it.
_STATE = re.compile(r"(?:has|have|no|not|non|with|without)[_-]", re.I)


def _is_aside(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _ASIDE or tag == "header" and not in_article:
        return True
    if tag in ("div", "section", "ul", "ol", "p", "span", "table", "aside", "header", "details", "figure"):
        names = _INNER.fullmatch if in_article else _BOILER.search
        return any(names(name) and not _STATE.match(name) for m in _MARK.findall(attributes) for name in m.strip("\"'").split())
    return False


class _Lines:
    """The lines of a page with (text, weight)."""

    def __init__(self) -> None:
        self.out: list[tuple[str, int, bool]] = []
        self.parts: list[str] = []
        self.linked = 0

    def end(self, aside: bool, in_article: bool) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            mostly_links = not in_article and self.linked > 0.6 * sum(map(len, self.parts))
            self.out.append((text, 0 if aside or mostly_links else len(text), in_article))
        self.parts, self.linked = [], 0


def _strip(page: str, wrapped: bool = False) -> list[tuple[str, int, bool]]:
    """The lines of a page; ``wrapped``: those of an article inside an aside count too."""
    closes: dict[str, int] = {}
    for m in _TOKEN.finditer(page):
        if m[3] and m[2]:
            closes[m[3].lower()] = m.start()  # where the last one closes
    lines, at = _Lines(), 0
    aside: list[str] = []  # open elements from the outermost aside on, of that element's name only
    held: list[tuple[int, list[str]]] = []  # asides around the open articles
    article = links = 0

    def add(text: str) -> None:
        if text:
            lines.parts.append(text)
            lines.linked += len(text) if links else 0

    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if m[1] or not m[3]:
            if m[1]:
                lines.parts.append(" ")
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if tag in _BLOCKS:
            lines.end(bool(aside), article > 0)
        elif tag == "br":
            lines.parts.append(" ")
        if tag == "a":
            links = 0 if closing else 1
        if aside:
            if tag == aside[0] and not m[4].rstrip().endswith("/"):
                if closing:
                    aside.pop()
                else:
                    aside.append(tag)
            elif tag in ("article", "main") and not closing and closes.get(aside[0], -1) < at:
                aside = []
            elif wrapped and tag in ("article", "main") and not closing:
                held.append((article, aside))
                aside = []
        elif not closing and tag not in _VOID and _is_aside(tag, m[4], article > 0) and closes.get(tag, -1) >= at:
            aside = [tag]
        if tag in ("article", "main"):
            article = max(0, article - 1) if closing else article + 1
            if closing and held and article == held[-1][0]:
                aside = held.pop()[1]
    add(page[at:])
    lines.end(bool(aside), article > 0)
    return lines.out


def _sums(weights: list[int], window: int) -> list[int]:
    """The weight of ``window`` lines from each one on."""
    return [sum(weights[i : i + window]) for i in range(len(weights))]


def text_ranges(weights: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """(first line, line behind the last one) of every range between a surge and its dive."""
    ranges, start = [], None
    for i, total in enumerate([*_sums(weights, window), 0]):
        if start is None and total >= surge and weights[i]:
            start = i
        elif start is not None and total == 0:
            ranges.append((start, i))
            start = None
    return ranges


def main_text(page: str | None, window: int = 6, surge: int = 80, share: float = 0.1, scale: int = 4) -> str:
    lines = _strip(page or "")
    if not any(inside and weight for _, weight, inside in lines) and max(_sums([w for _, w, _ in lines], window), default=0) < surge:
        again = _strip(page or "", wrapped=True)
        lines = again if any(inside and weight for _, weight, inside in again) else lines
    weights = [weight for _, weight, _ in lines]
    if any(inside and weight for _, weight, inside in lines):  # the page marks its article
        weights = [weight * scale if inside else 0 for _, weight, inside in lines]
    held = {(a, b): sum(len(lines[i][0]) for i in range(a, b) if weights[i]) for a, b in text_ranges(weights, window, surge)}
    kept = [r for r, n in held.items() if n >= share * max(held.values())] or [(0, len(lines))]
    return "\n\n".join(lines[i][0] for a, b in kept for i in range(a, b) if weights[i])


def extract_text(pages: DataFrame, **limits) -> DataFrame:
    """``pages`` (column html) with text and n_chars."""

    @F.pandas_udf("string")
    def extract(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, **limits) for x in column], dtype=object)

    out = pages.withColumn("text", F.coalesce(extract(F.col("html")), F.lit("")))
    return out.withColumn("n_chars", F.length("text").cast("long"))
