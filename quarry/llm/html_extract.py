"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page becomes a flat list of text blocks.  A block knows its word count, its link density
(share of its words inside links), the same of its two neighbours, and where it stands
(inside an article, inside page furniture, and how surely a class or id names furniture).  A
decision tree, trained on the labelled table below, tells content from the rest.
"""

from __future__ import annotations

import html
import itertools
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import prepare

# Elements of HTML by their role.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
DROPPED = {"template", "select", "button", "svg", "math", "canvas", "object", "audio", "video", "map", "option", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "header", "fieldset"}
CONTENT = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words in class, id or role that name page furniture, alone or in a longer name.
_FURNITURE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|toast|sidebar|widget\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|comments?|commentlist|respond|replies|disqus|share|sharing|social\w*|related|recommend\w*|newsletter|subscri\w*|signup|login|searchbox|searchform|popup|modal|overlay|paywall|pagination|pager|taglist|complementary|contentinfo)(?=$|[\s_-])|(?:^|\s)(?:site|page|top|global)[_-]header(?=$|\s)",
    re.I,
)
#: Words that name furniture when they are the whole name of a container, and say little otherwise.
_WEAK = "side|rail|foot|header|alert|legal|discussion|search\\w*|nav\\w*|tags|copyright|disclaimer|skip\\w*|reply|shar\\w+"
_WEAK_NAMES = re.compile(rf"(?:^|(?<=\s))(?:{_WEAK})(?=$|\s)", re.I)
_WEAK_WORDS = re.compile(rf"(?:^|[\s_-])(?:{_WEAK})(?=$|[\s_-])", re.I)
#: Headers of an article, whatever element they are.
_OWN_HEADER = re.compile(r"(?:^|(?<=\s))(?:entry|article|post|story|content|section)[_-]?header(?=$|\s)", re.I)
_CONTENT_WORDS = re.compile(r"(?:^|[\s_-])(?:article\w*|main|content|post|posts|entry|story|body|text|prose|page-content|hentry)(?=$|[\s_-])", re.I)

#: Classes of a layout that say what stands beside, as in has-sidebar, and classes of a topic, as in tag-advertising.
_LAYOUT_WORDS = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without|show|hide|is|js|tags?|category|cat|topic|subject|format|type|status|author|series)[-_][\w-]+", re.I)
#: Elements that a form for input does not hold.
_STRUCTURE = re.compile(r"<(?:article|main|nav|header|footer|h1)\b", re.I)
_FORM = re.compile(r"</?form\b", re.I)
_PARAGRAPH = re.compile(r"<p\b", re.I)
#: Paragraphs from which a form is a wrapper of the page.
FORM_PARAGRAPHS = 3
#: Words without links that one named element must hold, and times the words found outside it, to be the page's text in spite of its name.
NAMED_WORDS, NAMED_TIMES = 40, 4

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Elements that hold text themselves; a weak name says less about them than about a container.
TEXTUAL = HEADINGS | INLINE | {"p", "li", "pre", "blockquote", "td", "th", "dt", "dd", "figcaption"}
#: Elements that a stray end tag of an inner element doesn't close.
BARRIERS, INNER = FURNITURE | CONTENT, INLINE | {"p", "li"}


def _named(value: str, tag: str, in_article: bool) -> float:
    """How surely a class, id or role names page furniture: 1, 0.5 or 0."""
    value = _OWN_HEADER.sub("", _LAYOUT_WORDS.sub("", value))
    if _FURNITURE_WORDS.search(value):
        return 1.0
    weak = _WEAK_NAMES.search(value)
    if weak and tag not in TEXTUAL:
        return 0.0 if in_article and weak[0].lower() == "header" else 1.0
    return 0.5 if _WEAK_WORDS.search(value) else 0.0


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    article: bool
    furniture: bool
    named: float
    heading: bool
    root: int = -1  # the outermost element whose name means furniture
    inner: float = 0.0  # what the names inside that element say


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page.  Malformed markup never raises."""
    out: list[Block] = []
    parts: list[str] = []
    link_parts: list[str] = []
    # Open elements: (tag, article, furniture, named, dropped, heading, link, root, inner).
    stack: list[tuple] = [("", False, False, 0.0, False, False, False, -1, 0.0)]
    forms: list[int] | None = None  # where tags of forms stand
    # Places in the stack by tag, and of the elements that stray end tags don't leave.
    places: dict[str, list[int]] = {}
    barriers: list[int] = [0]
    at, n, lower, begun = 0, len(page), None, False

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                words = len(text.split())
                link = len(html.unescape(" ".join(link_parts)).split())
                _, article, furniture, named, _, heading, _, root, inner = stack[-1]
                out.append(Block(text, words, min(words, link), article, furniture, named, heading, root, inner))
            parts.clear()
            link_parts.clear()

    def close(depth: int) -> None:
        """Close all elements from ``depth`` on."""
        while len(stack) > depth:
            places[stack.pop()[0]].pop()
        while barriers[-1] >= depth:
            barriers.pop()

    def add(text: str) -> None:
        if text and not stack[-1][4]:
            parts.append(text)
            if stack[-1][6]:
                link_parts.append(text)

    while at < n:
        i = page.find("<", at)
        if i < 0:
            add(page[at:])
            break
        add(page[at:i])
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            at = n if j < 0 else j + 3
            continue
        if page.startswith(("<!", "<?"), i):
            j = page.find(">", i)
            at = n if j < 0 else j + 1
            continue
        m = _TAG.match(page, i)
        if m is None:
            after = page[i + 1 : i + 3]
            if after[:1].isalpha() or after[:1] == "/" and after[1:].isalpha():
                # A tag with an open quote, or without an end.
                j = page.find(">", i)
                at = n if j < 0 else j + 1
            else:
                add("<")
                at = i + 1
            continue
        at = m.end()
        tag = m[1].lower()
        closing = page[i + 1] == "/"
        if tag not in INLINE:
            if tag == "br":
                add(" ")
                continue
            flush()
        if closing:
            if (own := places.get(tag)) and (tag not in INNER or own[-1] > barriers[-1]):
                close(own[-1])
            continue
        if tag in RAW:
            if lower is None:
                lower = page.lower()
            # str.lower can change the length of a text; then search without it.
            j = lower.find(f"</{tag}", at) if len(lower) == n else next((x.start() for x in [re.compile(f"</{tag}", re.I).search(page, at)] if x), -1)
            k = page.find(">", j) if j >= 0 else -1
            at = n if k < 0 else k + 1
            continue
        if tag in VOID or m[2].endswith("/"):
            continue
        if tag == "p" and stack[-1][0] == "p" or tag == "li" and stack[-1][0] == "li":
            close(len(stack) - 1)
        top = stack[-1]
        own_name, dropped, said_content = 0.0, top[4] or tag in DROPPED, False
        if m[2]:
            for key, a, b, c in _ATTR.findall(m[2]):
                value, key = a or b or c, key.lower()
                if key == "style":
                    dropped |= bool(_HIDDEN.search(value))
                elif key == "hidden" or key == "aria-hidden":
                    dropped |= key == "hidden" or value.lower() == "true"
                elif tag not in ("body", "html") and not (tag == "header" and top[1]):
                    own_name = max(own_name, _named(value, tag, top[1]))
                    said_content |= bool(_CONTENT_WORDS.search(value))
        named, root, inner = max(top[3], own_name), top[7], max(top[8], own_name) if top[7] >= 0 else 0.0
        if tag in CONTENT and not begun and not top[2]:
            # The page's first article or main part counts whatever it and its wrappers are named.
            begun, named, root, inner = True, 0.0, -1, 0.0
        if named == 1.0 and root < 0:
            root, inner = i, 0.0
        article = top[1] or tag in CONTENT or said_content and not named
        # A heading block of an article may stand in its own header element.
        furniture = top[2] or tag in FURNITURE and not (tag == "header" and top[1])
        if tag == "form" and furniture and not top[2]:
            # A form around the page's parts or paragraphs asks for nothing.  Forms don't nest, so each is read once.
            if forms is None:
                forms = [x.start() for x in _FORM.finditer(page)]
            k = bisect_right(forms, i)
            end = forms[k] if k < len(forms) else n
            paragraphs = itertools.islice(_PARAGRAPH.finditer(page, at, end), FORM_PARAGRAPHS)
            furniture = not _STRUCTURE.search(page, at, end) and sum(1 for _ in paragraphs) < FORM_PARAGRAPHS
        places.setdefault(tag, []).append(len(stack))
        if tag in BARRIERS:
            barriers.append(len(stack))
        stack.append((tag, article, furniture, named, dropped, top[5] or tag in HEADINGS, top[6] or tag == "a", root, inner))
    flush()
    return out


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "article", "furniture", "named", "heading")


def features_of(blocks: list[Block]) -> np.ndarray:
    n = len(blocks)
    x = np.zeros((n, len(FEATURES)))
    x[:, 0] = [b.words for b in blocks]
    x[:, 1] = [b.link_words / b.words for b in blocks]
    x[1:, 2:4] = x[:-1, 0:2]
    x[:-1, 4:6] = x[1:, 0:2]
    for k, name in enumerate(("article", "furniture", "named", "heading"), 6):
        x[:, k] = [getattr(b, name) for b in blocks]
    return x


#: The labelled table.  Columns are FEATURES and the label (1: content).
LABELLED = np.array([
    # words ld  | before      | after       | art fur nam hea | label
    # menus, breadcrumbs, link lists
    [1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0, 0], [1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0, 0], [3, 1.0, 1, 1.0, 9, 0.0, 0, 1, 0, 0, 0],
    [2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 1, 0, 0], [4, 1.0, 3, 1.0, 5, 1.0, 0, 0, 0, 0, 0], [6, 1.0, 60, 0.0, 6, 1.0, 0, 0, 0, 0, 0],
    [5, 0.8, 4, 1.0, 7, 1.0, 0, 0, 0, 0, 0], [8, 0.7, 50, 0.0, 3, 0.0, 0, 0, 0, 0, 0], [7, 1.0, 40, 0.0, 6, 1.0, 1, 1, 0, 0, 0],
    [3, 1.0, 45, 0.0, 3, 1.0, 1, 0, 1, 0, 0], [12, 1.0, 2, 0.0, 11, 1.0, 0, 1, 1, 0, 0], [2, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 0],
    [30, 0.9, 20, 0.0, 3, 0.0, 0, 0, 0, 0, 0], [45, 0.8, 2, 0.0, 60, 0.0, 0, 0, 0, 0, 0],
    # page headers, site names, search and sign-up forms
    [3, 0.0, 0, 0.0, 4, 1.0, 0, 1, 0, 1, 0], [5, 0.2, 0, 0.0, 1, 1.0, 0, 1, 0, 0, 0], [4, 0.0, 0, 0.0, 30, 0.0, 0, 0, 1, 1, 0],
    [25, 0.0, 3, 0.0, 40, 0.0, 0, 1, 0, 0, 0], [18, 0.0, 50, 0.0, 2, 0.0, 1, 1, 0, 0, 0], [9, 0.0, 30, 0.0, 30, 0.0, 1, 1, 0, 0, 0],
    [60, 0.0, 70, 0.0, 10, 0.0, 1, 1, 0, 0, 0], [80, 0.0, 3, 0.0, 10, 0.0, 0, 1, 0, 0, 0], [2, 0.0, 5, 0.0, 80, 0.0, 0, 1, 0, 1, 0],
    # adverts, notices, related stories and reader comments, known by name
    [9, 0.0, 1, 1.0, 12, 0.0, 0, 0, 1, 0, 0], [30, 0.0, 1, 1.0, 12, 0.0, 0, 0, 1, 0, 0], [14, 0.1, 60, 0.0, 60, 0.0, 1, 0, 1, 0, 0],
    [70, 0.0, 60, 0.0, 20, 0.0, 1, 0, 1, 0, 0], [45, 0.0, 3, 0.0, 50, 0.0, 0, 0, 1, 0, 0], [150, 0.0, 4, 0.0, 90, 0.0, 0, 0, 1, 0, 0],
    [2, 0.0, 80, 0.0, 45, 0.0, 1, 0, 1, 1, 0], [2, 0.0, 80, 0.0, 45, 0.0, 0, 0, 1, 1, 0], [6, 0.0, 20, 0.0, 20, 0.0, 0, 0, 1, 0, 0],
    [200, 0.0, 100, 0.0, 0, 0.0, 1, 0, 1, 0, 0], [20, 0.3, 9, 0.0, 3, 1.0, 0, 0, 1, 0, 0], [11, 0.0, 2, 1.0, 200, 0.0, 0, 1, 1, 0, 0],
    # footers
    [7, 0.0, 60, 0.0, 0, 0.0, 0, 1, 0, 0, 0], [25, 0.1, 8, 0.0, 0, 0.0, 0, 1, 0, 0, 0], [12, 0.0, 3, 1.0, 0, 0.0, 0, 0, 1, 0, 0],
    [4, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0, 0, 0], [6, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0], [3, 0.0, 3, 0.0, 4, 0.0, 0, 0, 0, 0, 0],
    [40, 0.0, 40, 0.0, 0, 0.0, 1, 1, 0, 0, 0], [9, 0.0, 40, 0.0, 5, 0.0, 1, 1, 0, 0, 0],
    # article text, marked as such: headings, long and short paragraphs, paragraphs with links
    [12, 0.0, 9, 0.0, 80, 0.0, 1, 0, 0, 1, 1], [6, 0.0, 3, 1.0, 40, 0.0, 1, 0, 0, 1, 1], [4, 0.0, 60, 0.0, 50, 0.0, 1, 0, 0, 1, 1],
    [80, 0.0, 12, 0.0, 60, 0.0, 1, 0, 0, 0, 1], [2, 0.0, 80, 0.0, 40, 0.0, 1, 0, 0, 0, 1], [1, 0.0, 50, 0.0, 70, 0.0, 1, 0, 0, 0, 1],
    [1, 0.0, 1, 0.0, 1, 0.0, 1, 0, 0, 0, 1], [5, 0.0, 40, 0.0, 8, 0.0, 1, 0, 0, 0, 1], [60, 0.1, 30, 0.0, 20, 0.0, 1, 0, 0, 0, 1],
    [25, 0.4, 30, 0.0, 30, 0.0, 1, 0, 0, 0, 1], [9, 0.5, 30, 0.0, 30, 0.0, 1, 0, 0, 0, 1], [300, 0.0, 9, 0.0, 0, 0.0, 1, 0, 0, 0, 1],
    [3, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 0, 1], [40, 0.0, 2, 0.0, 2, 0.0, 1, 0, 0, 0, 1], [4, 1.0, 40, 0.0, 60, 0.0, 1, 0, 0, 0, 1],
    [6, 1.0, 2, 0.0, 40, 0.0, 1, 0, 0, 1, 1], [15, 0.0, 70, 0.0, 9, 0.0, 1, 0, 0, 0, 1], [20, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 0, 1],
    [8, 0.0, 6, 0.0, 7, 0.0, 1, 0, 0, 0, 1], [150, 0.2, 9, 1.0, 9, 1.0, 1, 0, 0, 0, 1], [2, 0.0, 2, 1.0, 3, 1.0, 1, 0, 0, 0, 1],
    # article text on pages that mark nothing
    [80, 0.0, 3, 1.0, 60, 0.0, 0, 0, 0, 0, 1], [60, 0.0, 80, 0.0, 70, 0.0, 0, 0, 0, 0, 1], [40, 0.1, 80, 0.0, 4, 0.0, 0, 0, 0, 0, 1],
    [25, 0.0, 50, 0.0, 40, 0.0, 0, 0, 0, 0, 1], [18, 0.0, 7, 0.0, 60, 0.0, 0, 0, 0, 0, 1], [4, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 0, 1],
    [2, 0.0, 40, 0.0, 50, 0.0, 0, 0, 0, 0, 1], [8, 0.0, 2, 1.0, 70, 0.0, 0, 0, 0, 1, 1], [5, 0.0, 60, 0.0, 80, 0.0, 0, 0, 0, 1, 1],
    [200, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1], [100, 0.2, 5, 1.0, 5, 1.0, 0, 0, 0, 0, 1], [50, 0.3, 60, 0.0, 60, 0.0, 0, 0, 0, 0, 1],
    [30, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 1], [70, 0.0, 10, 0.0, 0, 0.0, 0, 0, 0, 0, 1],
    # weak names: words and links decide
    [40, 0.0, 10, 0.0, 40, 0.0, 1, 0, 0.5, 0, 1], [90, 0.0, 4, 0.0, 0, 0.0, 1, 0, 0.5, 0, 1], [7, 0.0, 40, 0.0, 30, 0.0, 1, 0, 0.5, 0, 1],
    [5, 0.0, 0, 0.0, 40, 0.0, 1, 0, 0.5, 1, 1], [2, 0.0, 30, 0.0, 0, 0.0, 1, 0, 0.5, 0, 1], [15, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0.5, 0, 1],
    [60, 0.0, 3, 0.0, 50, 0.0, 0, 0, 0.5, 0, 1], [30, 0.0, 50, 0.0, 60, 0.0, 0, 0, 0.5, 0, 1], [80, 0.1, 0, 0.0, 0, 0.0, 0, 0, 0.5, 0, 1],
    [3, 0.0, 2, 0.0, 4, 0.0, 0, 0, 0.5, 0, 0], [6, 0.0, 60, 0.0, 2, 0.0, 0, 0, 0.5, 0, 0], [12, 0.3, 3, 0.0, 5, 0.0, 0, 0, 0.5, 0, 0],
    [4, 1.0, 3, 1.0, 3, 1.0, 1, 0, 0.5, 0, 0], [6, 1.0, 20, 0.0, 6, 1.0, 0, 0, 0.5, 0, 0], [3, 1.0, 80, 0.0, 3, 1.0, 1, 0, 0.5, 0, 0],
])


class Tree:
    """A binary decision tree grown by Gini impurity until its leaves are pure."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.at: list[tuple[int, float, int, int]] = []  # feature, threshold, left, right; feature -1: a leaf, threshold its label
        self._grow(x, y)

    def _grow(self, x: np.ndarray, y: np.ndarray) -> int:
        me = len(self.at)
        self.at.append((-1, float(y.mean() >= 0.5), 0, 0))
        best = None
        if 0 < y.sum() < len(y):
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[:-1] + values[1:]) / 2:
                    left = x[:, f] <= cut
                    gini = sum(len(s) * s.mean() * (1 - s.mean()) for s in (y[left], y[~left]))
                    if best is None or gini < best[0] - 1e-12:
                        best = (gini, f, cut)
        if best:
            left = x[:, best[1]] <= best[2]
            self.at[me] = (best[1], float(best[2]), self._grow(x[left], y[left]), self._grow(x[~left], y[~left]))
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        feature, threshold, left, right = (np.array(c) for c in zip(*self.at, strict=True))
        while (inner := feature[node] >= 0).any():
            k = node[inner]
            node[inner] = np.where(x[inner, feature[k]] <= threshold[k], left[k], right[k])
        return threshold[node] >= 0.5


def train_tree(table: np.ndarray = LABELLED) -> Tree:
    return Tree(table[:, :-1], table[:, -1])


def _text_in_spite_of_name(blocks: list[Block], keep: np.ndarray) -> int | None:
    """The element that holds the page's text though its name means furniture: most words without links, and hardly any elsewhere."""
    plain = Counter()
    for b in blocks:
        if not b.furniture and not b.heading:
            plain[b.root] += b.words - b.link_words
    named = [(n, -root) for root, n in plain.items() if root >= 0]
    if not named:
        return None
    n, root = max(named)
    found = sum(b.words - b.link_words for b, k in zip(blocks, keep, strict=True) if k and not b.heading)
    return -root if n >= NAMED_WORDS and n > NAMED_TIMES * found and 2 * n > sum(plain.values()) else None


def main_text(page: str | None, tree: Tree) -> str:
    """The content blocks of a page in order, joined by one space; empty for a null page."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    keep = tree.predict(features_of(blocks))
    if (root := _text_in_spite_of_name(blocks, keep)) is not None:
        blocks = [replace(b, named=b.inner, article=True) if b.root == root else b for b in blocks]
        keep = tree.predict(features_of(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_text(html_col: Column, tree: Tree | None = None) -> Column:
    """The main text of the pages in a column; null and empty pages give an empty string."""
    tree = tree or train_tree()

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p, tree) for p in pages.to_pylist()], pa.string())

    return extract(html_col.cast("string"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row; ids and urls may be null or repeat."""
    prepare(pages.sparkSession)
    out = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), extract_text(F.col(f"`{html_col}`")).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
