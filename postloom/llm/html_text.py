"""Main text of web pages: blocks labelled content or boilerplate by a minimum cut."""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import text_batches

# Element names and the words of class, id and role values that mark parts of a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe svg select option xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "th", "th": "td", "p": "p"}
_AWAY = frozenset("nav footer aside menu dialog button".split())
_FORM = frozenset("form fieldset".split())
_HOME = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_AWAY_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices newsletter popup modal overlay copyright colophon pagination pager contentinfo complementary".split()
)
_MAYBE_AWAY_WORDS = frozenset("banner toolbar search login signup subscribe social share sharing tags links skip".split())
#: Words for what heads or fills a page or an article alike: inside an article they say nothing.
_EITHER_WORDS = frozenset("header masthead alert alerts widget widgets meta form".split())
_HOME_WORDS = frozenset("article articlebody main content post entry story maincontent".split())

#: Words before another word that say that an element has or lacks it, not that it is it.
_ABOUT = frozenset("has have with without no not is hide show enable disable supports".split())
#: Marks that an article inside doesn't lift.
_ANSWERS = frozenset("comment comments reply replies respond disqus related recommended recommendations".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)>|<[!?/][^>]*>", re.S
)
_ATTR = re.compile(
    r"(?<![^\s\"'/])(class|id|role|itemprop|style|aria-hidden|hidden)(?![^\s=/>])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I
)
_NONE = re.compile(r"display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NEUTRAL, _HOME_TAG, _HOME_MARK, _HEADER, _SOFT, _MARKED, _ANSWER, _LOCKED = range(8)
#: Log odds that a block is content by what it stands in, and those of a block outside where the page has an article.
_ODDS = {_NEUTRAL: 0.0, _HOME_TAG: 1.0, _HOME_MARK: 1.0, _HEADER: -4.0, _SOFT: -4.0, _MARKED: -7.0, _ANSWER: -7.0, _LOCKED: -7.0}
_OUTSIDE = -3.0
#: Weights of the ties between blocks: neighbours, blocks of one parent; a boundary of a marked element counts as so many steps.
_NEXT, _SIBLING, _CROSSED = 2.0, 1.0, 7


@dataclass
class Block:
    text: str
    links: int
    element: int
    heading: bool


@dataclass
class Page:
    """Blocks in order, and the elements that they stand in: number of the parent, and what the element's own marks say."""

    blocks: list[Block]
    parents: list[int]
    kinds: list[int]


def _kind(tag: str, attrs: str) -> int:
    """What an element's name and attributes make it, whatever it stands in."""
    if tag in _AWAY or tag == "head":
        return _LOCKED
    found = _NEUTRAL
    for m in _ATTR.finditer(attrs) if attrs and not attrs.isspace() else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _NONE.search(value)):
            return _LOCKED
        if name in ("class", "id", "role", "itemprop") and tag not in ("html", "body"):
            for token in value.split():
                parts = [p.lower() for p in _PART.findall(token)] or [token.lower()]
                ends = {token.lower(), parts[-1]} | ({parts[0]} if parts[0] not in _ABOUT else set())
                if parts[0] in _ABOUT:
                    continue
                if ends & _ANSWERS:
                    found = max(found, _ANSWER)
                elif ends & _AWAY_WORDS:
                    found = max(found, _MARKED)
                elif ends & _MAYBE_AWAY_WORDS:
                    found = max(found, _SOFT)
                elif ends & _EITHER_WORDS:
                    found = max(found, _HEADER)
                elif ends & _HOME_WORDS:
                    found = max(found, _HOME_MARK)
    if tag in _HOME and found in (_NEUTRAL, _HOME_MARK, _HEADER, _SOFT):
        return _HOME_TAG
    if tag == "header":
        return max(found, _HEADER)
    return max(found, _MARKED) if tag in _FORM else found


def read_page(page: str) -> Page:
    """The page's runs of text between block elements, in order, with white space squeezed and references decoded."""
    out = Page([], [0], [_NEUTRAL])
    stack: list[tuple[str, int]] = []  # tag, number
    parts: list[str] = []
    links = inside_link = 0
    heading = False

    def close() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.blocks.append(Block(text, min(links, len(text)), stack[-1][1] if stack else 0, heading))
            parts.clear()
        links = 0

    def enter(tag: str, kind: int) -> None:
        out.parents.append(stack[-1][1] if stack else 0)
        out.kinds.append(kind)
        stack.append((tag, len(out.parents) - 1))

    def leave(tag: str) -> None:
        nonlocal heading
        while stack and stack.pop()[0] != tag:
            pass
        heading = any(t in _HEADINGS for t, _ in stack[-2:])

    at, end = 0, page.rfind(">") + 1  # behind it there is no tag
    while True:
        m = _TAG.search(page, at, end) if at < end else None
        chunk = page[at : m.start() if m else len(page)]
        if not m and "<!--" in chunk:
            chunk = chunk[: chunk.index("<!--")]
        if chunk:
            parts.append(chunk)
            links += len(chunk) * (inside_link > 0)
        if not m:
            break
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            break
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing, attrs = m[1], m[3] or ""
        if tag in _RAW:
            if not closing and not attrs.rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else (len(page) if tag in ("script", "style") else at)
            parts.append(" ")
            continue
        if tag == "a":
            inside_link = 0 if closing else 1
        if tag in _INLINE:
            if tag in ("br", "img", "input"):
                parts.append(" ")
            elif not closing and attrs and (kind := _kind(tag, attrs)) > _SOFT:
                close()
                enter(tag, kind)
            elif closing and stack and stack[-1][0] == tag:
                close()
                leave(tag)
            continue
        close()
        if closing:
            if any(t == tag for t, _ in stack):
                leave(tag)
                inside_link = 0
            continue
        if tag in _VOID:
            continue
        top = stack[-1][0] if stack else ""
        again = top and _SAME.get(top) in (tag, top) and tag in (top, _SAME.get(top))
        if (tag in _CLOSES_P and top == "p") or top == tag == "li" or again:
            leave(top)
        enter(tag, _kind(tag, attrs))
        if tag in _HEADINGS:
            heading = True
        elif tag in _CLOSES_P or tag in _SAME:
            heading = False
    close()
    return out


def settings(page: Page) -> list[int]:
    """What each element stands in, from its own mark and those above.

    Marks of boilerplate hold for all that is inside. Names of elements always do; an ``article`` or ``main`` inside lifts a mere
    class mark (that of comments only if it has half of the page's words), and a marked element with half of the
    words, outside of which there is no article, isn't what its class says.
    """
    n = len(page.kinds)
    locked = [k == _LOCKED for k in page.kinds]
    home = [k in (_HOME_TAG, _HOME_MARK) for k in page.kinds]
    for e in range(1, n):
        locked[e] |= locked[page.parents[e]]
        home[e] |= home[page.parents[e]]
    words, home_words = [0] * n, [0] * n
    for b in page.blocks:
        if not locked[b.element]:
            w = b.text.count(" ") + 1
            words[b.element] += w
            home_words[b.element] += w * home[b.element]
    for e in range(n - 1, 0, -1):
        words[page.parents[e]] += words[e]
        home_words[page.parents[e]] += home_words[e]
    out = list(page.kinds)
    for e in range(1, n):
        own, above = page.kinds[e], out[page.parents[e]]
        most = 2 * words[e] >= words[0] > 0
        if own in (_HEADER, _SOFT, _MARKED, _ANSWER) and most and home_words[0] == home_words[e]:
            own = _NEUTRAL
        if above == _LOCKED or own == _LOCKED:
            out[e] = _LOCKED
        elif own == _HOME_TAG:
            out[e] = _ANSWER if above == _ANSWER and not most else _HOME_TAG
        elif above in (_MARKED, _ANSWER) or own in (_MARKED, _ANSWER):
            out[e] = max(above, own)
        elif own == _HEADER:
            out[e] = above if above in (_HOME_TAG, _HOME_MARK, _SOFT) else _HEADER
        elif own == _SOFT:
            out[e] = _SOFT
        else:
            out[e] = above if own == _NEUTRAL or above in (_HEADER, _SOFT, _HOME_TAG) else own
    return out


def evidence(b: Block, setting: int, has_home: bool) -> float:
    """Log odds that a block is content, by its length, links and end and by what it stands in; of the order of the ties."""
    words = min(b.text.count(" ") + 1, 100)
    look = 1.2 * math.log1p(words) - 2.2 - 4 * b.links / len(b.text) + 0.6 * (b.text[-1] in ".!?:…»”\"") + 0.5 * b.heading
    return look + (_OUTSIDE if has_home and setting == _NEUTRAL else _ODDS[setting])


def ties(page: Page, found: list[int]) -> list[tuple[int, int, float]]:
    """(block, block, weight): neighbours in page order, the less the more steps lie between them in the tree, and the last block of the same parent."""
    edges, last = [], {}
    depth = [0] * len(page.parents)
    for e in range(1, len(depth)):
        depth[e] = depth[page.parents[e]] + 1
    for i, b in enumerate(page.blocks):
        if i:
            x, y, steps = page.blocks[i - 1].element, b.element, -2
            while x != y:
                if depth[x] >= depth[y]:
                    steps += 1 + _CROSSED * (found[x] != found[page.parents[x]])
                    x = page.parents[x]
                else:
                    steps += 1 + _CROSSED * (found[y] != found[page.parents[y]])
                    y = page.parents[y]
            edges.append((i - 1, i, _NEXT / (1 + max(0, steps))))
        kin = (page.parents[b.element], found[b.element])
        if last.get(kin, i) < i - 1:
            edges.append((last[kin], i, _SIBLING))
        last[kin] = i
    return edges


def min_cut(evidences: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut.

    A node is tied to the source by its evidence if that is above 0, to the sink by its amount otherwise; edges have their
    weight both ways. The flow is raised along shortest paths in level graphs until there is none.
    """
    n = len(evidences)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    near: list[list[int]] = [[] for _ in range(n + 2)]

    def tie(a: int, b: int, there: float, back: float) -> None:
        near[a].append(len(to))
        to.append(b)
        room.append(there)
        near[b].append(len(to))
        to.append(a)
        room.append(back)

    if all(e > 0 for e in evidences) or all(e <= 0 for e in evidences):
        return [e > 0 for e in evidences]
    for i, e in enumerate(evidences):
        tie(source, i, e, 0.0) if e > 0 else tie(i, sink, -e, 0.0)
    for a, b, w in edges:
        tie(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        line = deque([source])
        while line:
            a = line.popleft()
            for k in near[a]:
                if room[k] > 1e-12 and level[to[k]] < 0:
                    level[to[k]] = level[a] + 1
                    line.append(to[k])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(room[k] for k in path)
                for j, k in enumerate(path):
                    room[k] -= flow
                    room[k ^ 1] += flow
                full = next(j for j, k in enumerate(path) if room[k] <= 1e-12)
                at = to[path[full] ^ 1]
                del path[full:]
                continue
            while turn[at] < len(near[at]):
                k = near[at][turn[at]]
                if room[k] > 1e-12 and level[to[k]] == level[at] + 1:
                    break
                turn[at] += 1
            if turn[at] < len(near[at]):
                path.append(k)
                at = to[k]
            elif path:
                at = to[path.pop() ^ 1]
                turn[at] += 1
            else:
                break


def main_text(page: str | None) -> str:
    """The article's blocks joined by line feeds; empty if the page is null, empty or has none.

    The :func:`evidence` of a block is what it costs to put it on the other side, the :func:`ties` what it costs to part two
    blocks; the minimum cut is the cheapest labelling.
    """
    if not page:
        return ""
    read = read_page(page)
    found = settings(read)
    has_home = any(found[b.element] in (_HOME_TAG, _HOME_MARK) for b in read.blocks)
    kept = min_cut([evidence(b, found[b.element], has_home) for b in read.blocks], ties(read, found))
    if not any(kept):  # a page of short lines alone: what nothing marks and no links fill
        kept = [found[b.element] in (_NEUTRAL, _HOME_TAG, _HOME_MARK) and 2 * b.links < len(b.text) for b in read.blocks]
    return "\n".join(b.text for b, k in zip(read.blocks, kept, strict=True) if k)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages: the main text and its length in code points.

    Null, empty and textless pages give an empty text. Each row is worked on by itself, so repeated rows give
    repeated results and nothing is shuffled; other columns are not read.
    """
    text_batches(pages.sparkSession)
    three = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = T.StructType([three.schema["page_id"], three.schema["url"], T.StructField("text", T.StringType())])
    return three.mapInArrow(run, out).withColumn("n_chars", F.char_length("text").cast("long"))
