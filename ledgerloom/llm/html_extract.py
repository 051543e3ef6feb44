"""Main text of HTML pages by line-block distribution."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import tune

#: HTML element names by the part they play.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNCLOSED = frozenset("p li dt dd td tr th".split())  # often left open: they hide nothing by themselves
HIDDEN = frozenset("script style noscript template svg math iframe object canvas head title textarea select button option audio video".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
MAIN = frozenset("article main".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Names in class, id or role that mark boilerplate. Words before the noun may qualify it (site-footer) but not
#: deny or merely mention it (no-sidebar, has-sidebar), and those after it may only name its container or state (nav-menu-list).
NOISE = re.compile(
    r"[_-]*(?:(?!(?:no|not|non|has|have|with|without|hide|hidden|disabled?|off)[_-])[^\s_-]+[_-]+)*"
    r"(?:ads?|adv|advert\w*|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|footnotes?bar|gdpr|header|masthead|menu|modal|nav\w*|newsletter|notices?|pagination|pager|popup|promo\w*|related|replies|reply|respond|share|sharing|sidebar\w*|side|skip|social|sponsor\w*|subscribe|toolbar|topbar|widget\w*|contentinfo|complementary|navigation|search)\d*"
    r"(?:[_-]+(?:\d+|[a-z]|active|area|bar|blocks?|bottom|box|buttons?|col|column|container|content|desktop|fixed|form|group|icons?|inner|items?|left|links?|list|main|mobile|nav|open|outer|panel|posts?|primary|right|row|secondary|section|signup|slot|sticky|text|title|toggle|top|unit|wrap|wrapper))*[_-]*", re.I)
SPLIT = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</?[a-zA-Z](?:[^>=]+|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+(?:>|\Z)", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "textarea", "title", "iframe", "noscript")}
SPACE = re.compile(r"\s+")


def lines(html: str) -> list[tuple[str, int, bool, tuple[int, ...]]]:
    """(text, weight, in a main element, boilerplate by name around it) of each block of a page, in order, without markup.

    The weight is the block's length outside links, of a heading's its whole length; a block inside boilerplate elements
    has weight -1. A header inside a main element is the article's own heading, whatever its name. Elements that
    their names mark as boilerplate are numbered, and the last item has the numbers of those around the block.
    """
    out: list[tuple[str, int, bool, tuple[int, ...]]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, int]] = []  # open containers, and whether each hides (2), is boilerplate (1), so by name (3) or main (-1)
    depth: Counter = Counter()
    of: Counter = Counter()
    named: list[int] = []
    at, anchors, names = 0, 0, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                weight = -1 if of[1] else max(0, len(text) - linked)
                out.append((text, weight, of[-1] > 0, tuple(named)))
            parts.clear()
        linked = 0

    size, search = len(html), SPLIT.search
    while at < size:
        tag = search(html, at)
        end = tag.start() if tag else size
        if end > at and not of[2]:
            parts.append(html[at:end])
            if anchors and not any(depth[h] for h in HEADINGS):
                linked += end - at
        if not tag:
            break
        at, token = tag.end(), tag[0]
        read = NAME.match(token)
        if not read:
            continue
        name, closing = read[1].lower(), token[1] == "/"
        if not closing and name in RAW_END:
            stop = RAW_END[name].search(html, at)
            at = stop.end() if stop else size
            if name not in INLINE:
                close()
            continue
        if name == "a":
            anchors = max(0, anchors + (-1 if closing else 1))
            continue
        if name not in INLINE:
            close()
            if name not in UNCLOSED and name != "br":
                anchors = 0
        if name in VOID or token.endswith("/>"):
            continue
        if closing:
            if depth[name]:
                while stack:
                    old, kind = stack.pop()
                    depth[old] -= 1
                    of[kind] -= 1
                    if kind == 3:
                        named.pop()
                    if old == name:
                        break
            continue
        if name in UNCLOSED or name in INLINE and name != "span":
            continue
        kind = 2 if name in HIDDEN else 1 if name in BOILERPLATE else -1 if name in MAIN else 0
        own_header = name == "header" and of[-1]
        if own_header:
            kind = 0
        if kind == 0 and not own_header and name not in ("body", "html") and any(NOISE.fullmatch(x) for a, b, c in MARKS.findall(token) for x in (a or b or c).split()):
            kind = 3
            names += 1
            named.append(names)
        stack.append((name, kind))
        depth[name] += 1
        of[kind] += 1
    close()
    return out


def trusted(found: list[tuple[str, int, bool, tuple[int, ...]]]) -> list[tuple[str, int]]:
    """(text, weight) of blocks, -1 inside boilerplate by name. A name isn't believed that marks over nine tenths of the weight, and none if they mark all of it."""
    marked: Counter = Counter()
    for _, w, _, around in found:
        marked.update(dict.fromkeys(around, max(0, w)))
    total = sum(w for _, w, _, _ in found if w > 0)
    believed = {x for x, w in marked.items() if 10 * w <= 9 * total}
    out = [(text, w if believed.isdisjoint(around) else -1) for text, w, _, around in found]
    return out if any(w > 0 for _, w in out) else [(text, w) for text, w, _, _ in found]


def main_text(html: str | None, window: int = 3, surge: int = 40) -> str:
    """The text of the article or main elements, or between surges and dives of the blocks' lengths over windows of blocks.

    Where the page has article or main elements with any weight, their blocks from the first to the last with weight
    are the text, those without weight between them, too. Else a region begins where the window's
    sum comes to `surge` code points or more and is drawn back to the first block in that window with any weight; it
    ends where the sums fall to nothing. Boilerplate blocks are left out; the others stay whole. If no
    window surges, all blocks with weight are the text.
    """
    blocks = lines(html or "")
    main = trusted([x for x in blocks if x[2]])
    heavy = [i for i, (_, w) in enumerate(main) if w > 0]
    if heavy:
        return " ".join(text for text, w in main[heavy[0] : heavy[-1] + 1] if w >= 0)
    found = trusted(blocks)
    weight = [w for _, w in found]
    length = [max(0, w) for w in weight]
    sums = [sum(length[i : i + window]) for i in range(len(length))]
    keep, inside = [False] * len(length), False
    for i, s in enumerate(sums):
        if not inside and s >= surge:
            inside = True
        elif inside and s == 0:
            inside = False
        keep[i] = inside
    for i in range(len(length) - 1, 0, -1):  # draw back over weighty blocks next to a region: none is dropped at its rim
        if keep[i] and not keep[i - 1] and length[i - 1]:
            keep[i - 1] = True
    if not any(keep):
        keep = [x > 0 for x in length]
    return " ".join(text for (text, _), k, w in zip(found, keep, weight) if k and w >= 0)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages without html, with out (the main text, empty if none) and n_chars (its code points).

    Null html counts as empty. Rows are handled one by one in place, whatever their length; repeats stay. Columns of
    pages named like the new ones are replaced.
    """
    tune(pages.sparkSession)
    rest = [c for c in pages.columns if c not in (html, out, "n_chars")]
    schema = T.StructType([*(pages.schema[c] for c in rest), T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [main_text(x.as_py()) for x in part.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(rest))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*rest, out, "n_chars"])

    return pages.select(*(pages[c] for c in rest), pages[html]).mapInArrow(run, schema)
