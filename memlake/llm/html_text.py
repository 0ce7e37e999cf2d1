"""Main-text extraction from HTML: flat text blocks and a decision tree.

A page is cut into text blocks at block-level tags. A block is described by its own and its
neighbours' word count and link density, and by its zone: inside an article, inside an element that by
its tag or its class, id or role is page furniture, or neither. A small decision tree, trained
(Gini, exact splits) on TRAINING, a table of labelled blocks, says which blocks are main text.

Scripts, styles, comments and the head give no blocks. Character references are decoded once, white space
inside a block becomes one space, and the main blocks are joined by line feeds.

Tags are scanned once from left to right, so the time is linear in the page. A tag ends at its `>`, or before the
next `<` outside a quoted value. Opening and closing tags of one name are paired like brackets:

* The head ends at its closing tag or at the first tag that may not stand in it.
* Other silent elements are skipped up to their closing tag. A self-closed one is empty, of one that nothing closes
  the text up to the next block tag is skipped. An unclosed script or style reaches to the end of the page.
* Furniture that nothing closes ends where an article, main or h1 element begins.
* A form, or a class that names layout (sidebar, header, ...), does not make furniture of the element that holds the page's
  main element, or else its first article with an h1, or else its first article. Comments, adverts and the like stay furniture
  unless they hold the main element.

Defined cases: a null or empty page, or one without main text, gives the empty text. Tags left open or closed
twice do no harm: a closing tag ends the innermost open element of its name, if any. Of equally good cuts the tree takes
the first feature and the least value. Pages of any length and depth are read whole. Repeated rows
are each extracted alike. Other columns of the input are kept or ignored as asked, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import register, text_of
from memlake.sources.tables import read_table

_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_SILENT = frozenset("noscript template svg math object canvas select datalist button audio video".split())
_IN_HEAD = frozenset("html head title meta link base script style noscript template".split())
_NAME = re.compile(r"[a-zA-Z][^\s/<>]*")
_STOP = re.compile(r"[<>\"']")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW}
_INLINE = frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
                     "samp small span strike strong sub sup time tt u var wbr").split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that the next one of their name ends.
_FOLLOWED = frozenset("p li dt dd option tr td th".split())
_FURNITURE = frozenset("nav header footer aside form menu dialog fieldset option".split())
_ARTICLE = frozenset("article main".split())
_LAYOUT = re.compile(
    r"(?:^|[\s_-])(?:banner|nav\w*|menu\w*|breadcrumbs?|sidebars?|side|aside|footer|foot|header|masthead|notice\w*|alert|"
    r"social|widget|pagination|pager|toolbar|search|copyright|legal|disclaimer|complementary|contentinfo|form)(?=$|[\s_-])", re.I)
_EXTRA = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|login|"
    r"comments?|replies|reply|disqus|discussion|share|sharing|related|recommend\w*)(?=$|[\s_-])", re.I)
#: Class names that tell of a page's state or subject, or of a frame around the content, not of furniture.
_STATE = re.compile(r"(?:has|no|with|without|is|category|cat|tag|format)[_-].*|.*[_-](?:open|closed|enabled|disabled)"
                    r"|(?:.*[_-])?(?:content|main)[_-].*(?:wrap|wrapper|layout|container)", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")  # commentList names comments as comment-list does
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HREF = re.compile(r"(?<![\w-])href\s*=", re.I)

#: Zones of a block.
NONE, ARTICLE, FURNITURE = 0, 1, 2
FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "zone")
#: Labelled blocks: the features in order, then 1 for main text and 0 for the rest.
TRAINING = np.array([
    # article paragraphs, headings and short lines
    (80, .00, 60, .00, 70, .00, 1, 1), (45, .05, 12, .00, 90, .00, 1, 1), (10, .00, 4, 1.0, 120, .02, 1, 1), (1, .00, 40, .00, 55, .00, 1, 1),
    (3, .00, 2, .00, 30, .00, 1, 1), (150, .30, 80, .00, 20, .00, 1, 1), (25, .60, 60, .00, 60, .00, 1, 1), (6, 1.0, 80, .00, 75, .00, 1, 1),
    (2, .00, 1, .00, 0, .00, 1, 1), (12, .00, 0, .00, 0, .00, 1, 1), (5, .00, 5, .00, 5, .00, 1, 1), (400, .01, 9, .00, 10, .00, 1, 1),
    # article without an article element
    (60, .00, 50, .00, 70, .00, 0, 1), (35, .10, 9, .00, 40, .05, 0, 1), (120, .02, 3, 1.0, 80, .00, 0, 1), (22, .00, 70, .00, 4, 1.0, 0, 1),
    (9, .00, 60, .00, 75, .00, 0, 1), (8, .00, 3, 1.0, 90, .00, 0, 1), (4, .00, 45, .00, 50, .00, 0, 1), (300, .00, 0, .00, 0, .00, 0, 1),
    (16, .00, 0, .00, 30, .00, 0, 1), (14, .20, 25, .00, 28, .00, 0, 1),
    # paragraphs beside lines of links, in an article and outside
    (21, .00, 21, .00, 4, 1.0, 1, 1), (60, .00, 4, 1.0, 2, 1.0, 1, 1), (4, 1.0, 21, .00, 21, .00, 1, 1), (30, .00, 2, 1.0, 3, 1.0, 1, 1),
    (3, 1.0, 4, 1.0, 25, .00, 1, 1), (5, .90, 30, .10, 4, 1.0, 1, 1), (2, .00, 3, 1.0, 5, 1.0, 1, 1), (8, .40, 2, 1.0, 2, 1.0, 1, 1),
    (21, .00, 21, .00, 4, 1.0, 0, 1), (63, .00, 0, .00, 4, 1.0, 0, 1), (21, .00, 4, 1.0, 0, .00, 0, 1), (40, .05, 3, 1.0, 4, 1.0, 0, 1),
    (90, .10, 2, 1.0, 5, 1.0, 0, 1), (28, .30, 50, .00, 3, 1.0, 0, 1), (18, .00, 2, 1.0, 45, .00, 0, 1), (25, .15, 4, .90, 2, .90, 0, 1),
    (4, 1.0, 21, .00, 21, .00, 0, 1), (6, 1.0, 80, .00, 75, .00, 0, 1), (5, .90, 40, .05, 30, .10, 0, 1), (2, .00, 21, .00, 40, .00, 0, 1),
    (1, .00, 0, .00, 21, .00, 0, 1), (6, .00, 3, 1.0, 35, .00, 0, 1), (7, .10, 0, .00, 24, .00, 0, 1), (3, .00, 60, .00, 25, .00, 0, 1),
    # items of link lists behind and before paragraphs
    (4, 1.0, 63, .00, 6, 1.0, 0, 0), (6, 1.0, 4, 1.0, 0, .00, 0, 0), (5, 1.0, 90, .00, 0, .00, 0, 0), (8, 1.0, 120, .05, 7, .90, 0, 0),
    (7, .90, 8, 1.0, 80, .00, 0, 0), (3, 1.0, 2, 1.0, 21, .00, 0, 0), (5, 1.0, 0, .00, 50, .00, 0, 0), (12, 1.0, 40, .00, 11, 1.0, 0, 0),
    (10, .80, 9, .90, 30, .00, 0, 0), (2, 1.0, 25, .00, 2, 1.0, 0, 0),
    # loose links, buttons, bylines and notes outside an article
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (2, 1.0, 2, 1.0, 3, 1.0, 0, 0), (4, 1.0, 1, 1.0, 60, .00, 0, 0), (3, .00, 2, 1.0, 2, 1.0, 0, 0),
    (6, .50, 3, 1.0, 2, 1.0, 0, 0), (15, .90, 12, .90, 14, .90, 0, 0), (30, .80, 20, .80, 4, 1.0, 0, 0), (5, .00, 0, .00, 2, 1.0, 0, 0),
    (7, .00, 4, 1.0, 0, .00, 0, 0), (2, .00, 1, .00, 3, .00, 0, 0), (4, .00, 3, 1.0, 5, .00, 0, 0), (9, .70, 40, .00, 3, 1.0, 0, 0),
    # furniture, however long
    (1, 1.0, 0, .00, 1, 1.0, 2, 0), (12, .00, 1, 1.0, 60, .00, 2, 0), (40, .00, 50, .00, 0, .00, 2, 0), (90, .02, 70, .00, 30, .00, 2, 0),
    (200, .00, 4, .00, 9, .00, 2, 0), (5, .00, 80, .00, 80, .00, 2, 0), (25, .40, 6, 1.0, 7, 1.0, 2, 0), (3, .00, 0, .00, 0, .00, 2, 0),
    (60, .00, 60, .00, 60, .00, 2, 0), (18, .00, 22, .00, 100, .00, 2, 0), (8, .90, 9, .90, 8, .90, 2, 0), (33, .00, 5, .00, 41, .00, 2, 0),
])
MAX_DEPTH = 8


def grow(table: np.ndarray = TRAINING, depth: int = MAX_DEPTH):
    """A Gini tree: a label, or (feature, cut, tree below or at the cut, tree above)."""
    x, y = table[:, :-1], table[:, -1]
    if depth == 0 or y.min() == y.max():
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            score = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (left, ~left))
            if best is None or score < best[0] - 1e-12:
                best = (score, f, float(cut), left)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, cut, left = best
    return (f, cut, grow(table[left], depth - 1), grow(table[~left], depth - 1))


def judge(tree, x) -> int:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if x[f] <= cut else high
    return tree


def tokens(page: str) -> list[tuple[str, bool, str, int, int]]:
    """(name, closing, attributes, start, end) of the page's tags in order; comments, declarations and elements of
    raw text are one token each without a name."""
    out = []
    last = {q: page.rfind(q) for q in "\"'"}
    unclosed: set[str] = set()
    at, n = 0, len(page)
    while (start := page.find("<", at)) >= 0:
        closing = page.startswith("/", start + 1)
        name = _NAME.match(page, start + 1 + closing)
        if name is None:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 2)
                at = n if end < 0 else end + 3
            elif closing or page.startswith(("<!", "<?"), start):
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            else:  # a mere less-than sign
                at = start + 1
                continue
            out.append(("", False, "", start, at))
            continue
        tag, i, end = name[0].lower(), name.end(), n
        while (stop := _STOP.search(page, i)) is not None:
            k = stop.start()
            if stop[0] in "<>":
                end = k
                break
            i = k + 1
            before = k - 1
            while page[before].isspace():
                before -= 1
            if page[before] == "=" and last[stop[0]] > k:  # the value reaches to the next such quote
                i = page.index(stop[0], i) + 1
        attributes = page[name.end():end]
        at = end + 1 if end < n and page[end] == ">" else end
        if tag in _RAW:
            close = None
            if not closing and not attributes.endswith("/") and tag not in unclosed:
                close = _RAW_END[tag].search(page, at)
                if close is None:
                    unclosed.add(tag)
                    if tag in ("script", "style"):
                        at = n
            at = close.end() if close else at
            out.append(("", False, "", start, at))
        else:
            out.append((tag, closing, attributes, start, at))
    return out


def _pairs(found: list[tuple]) -> dict[int, int]:
    """The closing token of each opening one that has one: brackets of each name apart."""
    waiting: dict[str, list[int]] = {}
    out = {}
    for i, (tag, closing, attributes, _, _) in enumerate(found):
        if closing:
            if waiting.get(tag):
                out[waiting[tag].pop()] = i
        elif tag and not attributes.endswith("/"):
            waiting.setdefault(tag, []).append(i)
    return out


def _key(found: list[tuple], pairs: dict[int, int], heads: list[int]) -> int | None:
    """The main element, or else the first article with an h1, or else the first article."""
    articles = [i for i, t in enumerate(found) if t[0] == "article" and not t[1]]
    mains = [i for i, t in enumerate(found) if t[0] == "main" and not t[1]]
    titled = [i for i in articles if heads[pairs.get(i, len(found))] > heads[i]]
    return next(iter(mains + titled + articles), None)


def _named(attributes: str) -> tuple[bool, bool]:
    """Whether class, id or role name layout furniture, and whether they name extras such as comments or adverts."""
    layout = extra = False
    for m in _NAMES.finditer(attributes):
        for word in (m[1] or m[2] or m[3] or "").split():
            word = _HUMP.sub("-", word)
            if not _STATE.fullmatch(word):
                layout = layout or _LAYOUT.search(word) is not None
                extra = extra or _EXTRA.search(word) is not None
    return layout, extra


def blocks(page: str) -> list[tuple[str, int, float, int]]:
    """(text, words, link density, zone) of the page's text blocks in order."""
    out: list[tuple[str, int, float, int]] = []
    found = tokens(page)
    pairs = _pairs(found)
    heads = list(accumulate((t[0] == "h1" and not t[1] for t in found), initial=0))
    key = _key(found, pairs, heads)
    stack: list[tuple[str, int, bool]] = []  # open elements: name, zone with that of the elements around, unclosed furniture
    open_names: Counter[str] = Counter()
    loose = 0
    pieces: list[str] = []
    linked: list[str] = []
    anchor = lasting = in_head = muted = False

    def zone(i: int, tag: str, attributes: str) -> int:
        end = pairs.get(i, len(found))
        holds = key is not None and i <= key <= end
        if tag == "form" and key is None:
            holds = heads[end] > heads[i]
        layout, extra = _named(attributes) if attributes and tag not in ("html", "body") else (False, False)
        if (tag in _FURNITURE and not (tag == "form" and holds)) or (layout and not holds) \
                or (extra and not (holds and found[key][0] == "main" if key is not None else False)):
            return FURNITURE
        return ARTICLE if tag in _ARTICLE else NONE

    def flush() -> None:
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            words = text.count(" ") + 1
            inside = len(entities.unescape(" ".join(linked)).split())
            out.append((text, words, min(1.0, inside / words), stack[-1][1] if stack else NONE))
        pieces.clear()
        linked.clear()

    def end_from(depth: int) -> None:
        nonlocal loose
        for name, _, unclosed in stack[depth:]:
            open_names[name] -= 1
            loose -= unclosed
        del stack[depth:]

    def say(text: str) -> None:
        if text and not in_head and not muted:
            pieces.append(text)
            if anchor:
                linked.append(text)

    at, i = 0, 0
    while i < len(found):
        tag, closing, attributes, start, end = found[i]
        say(page[at:start])
        at = end
        here, i = i, i + 1
        if not tag:
            continue
        if in_head and (tag == "head" if closing else tag not in _IN_HEAD):
            in_head = False
        if tag == "head":
            in_head = not closing
            continue
        if tag in _SILENT:
            if not closing and here in pairs:
                i = pairs[here] + 1
                at = found[i - 1][4]
            elif not closing:
                muted = not attributes.endswith("/")
            continue
        if tag == "a":
            anchor = not closing and _HREF.search(attributes) is not None
            lasting = anchor and here in pairs
        if tag == "br":
            say(" ")
        if tag in _INLINE or "-" in tag:
            continue
        flush()
        muted = False
        anchor = anchor and lasting
        if closing:
            if open_names[tag]:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                end_from(depth)
        elif tag not in _VOID and not attributes.endswith("/"):
            if loose and tag in ("article", "main", "h1"):
                end_from(next(d for d, e in enumerate(stack) if e[2]))
            if tag in _FOLLOWED and stack and stack[-1][0] == tag:
                end_from(len(stack) - 1)
            own = zone(here, tag, attributes)
            unclosed = own == FURNITURE and here not in pairs
            stack.append((tag, max(own, stack[-1][1] if stack else NONE), unclosed))
            open_names[tag] += 1
            loose += unclosed
    say(page[at:])
    flush()
    return out


def main_text(page: str, tree) -> str:
    found = blocks(page)
    lines = []
    for i, (text, words, links, zone) in enumerate(found):
        _, pw, pl, _ = found[i - 1] if i else ("", 0, 0.0, 0)
        _, nw, nl, _ = found[i + 1] if i + 1 < len(found) else ("", 0, 0.0, 0)
        if judge(tree, (words, links, pw, pl, nw, nl, zone)):
            lines.append(text)
    return "\n".join(lines)


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """`pages` with the main text in `out_col` in place of the HTML."""
    tree = grow()

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([main_text(p, tree) for p in series], dtype="object")
    keep = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in (html_col.lower(), out_col.lower())]
    return pages.select(*keep, extract(text_of(html_col)).alias(out_col))


@register("op2_html_blocks")
def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).withColumn("n_chars", F.length("text").cast("bigint"))
