"""Operator 2: main text of web pages by minimum cuts.

A page becomes blocks: the text between two boundaries of block elements. A small linear classifier over a block's
words, links and elements gives each block a cost of being called boilerplate or content; these are the capacities to
the two terminals. Neighbouring blocks, and blocks that follow each other inside the same element, are joined by edges
whose capacity grows with the share of elements they have in common. A maximum flow finds the cheapest labelling; the
blocks on the side of the content terminal are the text, in page order.

Class names and ids, and <form>, are weak marks of boilerplate: layout wrappers carry them too. A weak mark does not count
if its element holds <main>, an article at least as long as all unmarked text, or nearly all text of a page without other
content; its cost is finite. Words of a layout's state ('has-comments') are no marks, nor are 'header' names inside content.

Scripts, styles, comments, form controls and hidden elements are no text at all. Unclosed elements end with their
parents, text after a cut-off tag is dropped with the tag, and character references are decoded after cutting.

Cases: a null or empty page, and a page without content, give an empty text; every row is read on its own, so repeated
rows, null ids and other columns (not read) do no harm; pages may be of any length.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from treeline.llm.tokens import slices

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noembed noframes xmp iframe".split())
SILENT = frozenset("head script style textarea title noembed noframes xmp iframe noscript template svg math canvas object audio video select button datalist".split())
BOILERPLATE = frozenset("nav aside footer form menu dialog search".split())
WEAK = frozenset(["form"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table div section article aside nav main body form".split())

_BAD = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent\w*|gdpr|notice\w*|alert\w*|newsletter\w*|"
    r"subscri\w*|signup|login|share\w*|sharing|social\w*|sidebar\w*|side-bar|related\w*|recommend\w*|comment\w*|respond|reply|replies|disqus\w*|discussion|"
    r"breadcrumb\w*|menu\w*|nav\w*|navbar|toolbar|footer\w*|foot|masthead|topbar|header\w*|copyright\w*|legal|widget\w*|popup\w*|modal\w*|overlay\w*|"
    r"pagination|pager|search\w*|tags|tagcloud|meta|byline|skip\w*|hidden|sr-only|visually-hidden)(?=$|[\s_-])",
    re.I,
)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|content|maincontent|main|post|post-body|entry|story|text|body|prose|page-content)(?=$|[\s_-])", re.I)
_HEADER = re.compile(r"(?:^|(?<=[\s_-]))(?:header\w*|masthead)(?=$|[\s_-])", re.I)
_STATE = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no)[_-]\S*", re.I)
_ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "dialog": -1, "alert": -1, "form": -1, "main": 1, "article": 1}
_QUOTED = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*+>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_OPENING = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_CLOSING = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}

# Classifier: hand-set weights, and what a whole shared path adds between neighbours.
BIAS, PER_LOG_WORD, LINKS, PARAGRAPH, HEADING, IN_CONTENT, IN_BOILERPLATE = -3.0, 1.2, -5.0, 2.0, 1.0, 7.0, -40.0
IN_WEAK = -12.0
# A weakly marked element without an article needs so many times the unmarked text, and so many paragraphs or an <h1>.
MOST, PARAGRAPHS = 3, 3
SMOOTH = 2.0
UNIT = 100


@dataclass(slots=True)
class _Element:
    tag: str
    number: int
    side: int  # 1: content, -1: boilerplate, 0: neither
    silent: bool
    weak: bool = False  # a mark that what the element holds can lift
    chief: str = ""  # "main" or "article"


@dataclass(slots=True)
class Block:
    """Text of one block with what the classifier and the edges look at."""

    text: str
    tag: str
    path: tuple[int, ...]
    side: int = 0
    words: int = 0
    linked: int = 0
    score: float = field(default=0.0)
    weak: bool = False


def _element(tag: str, attributes: str, number: int, inside_content: bool) -> _Element:
    side = -1 if tag in BOILERPLATE else 1 if tag in ("article", "main") else 0
    if tag == "header" and not inside_content:
        side = -1
    weak = tag in WEAK
    chief = tag if side > 0 else ""
    silent = tag in SILENT
    if attributes:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        named = f"{found.get('class', '')} {found.get('id', '')}"
        role = found.get("role", "").lower()
        if role in _ROLES:
            side = _ROLES[role]
            weak = role in WEAK
            chief = role if side > 0 else ""
        elif named != " " and tag not in ("body", "html"):
            marks = _STATE.sub("", named)
            if _BAD.search(_HEADER.sub("", marks) if inside_content else marks) and tag not in ("article", "main"):
                weak |= side >= 0
                side = -1
            elif side == 0 and _GOOD.search(named):
                side = 1
        style = found.get("style", "").replace(" ", "").lower()
        silent |= "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    return _Element(tag, number, side, silent, weak and side < 0, chief)


def _lift_weak_marks(blocks: list[Block], made: dict[int, _Element]) -> None:
    """Takes the weak marks off elements that hold the page's content, those with most text first."""
    chains: list[tuple[Block, list[int], dict[int, int]]] = []
    for block in blocks:
        path = [made[n] for n in block.path]
        if any(e.side < 0 and not e.weak for e in path):
            continue
        weak = [e.number for e in path if e.weak]
        article: dict[int, int] = {}  # of a weakly marked element: the outermost article below it
        for e in reversed(path):
            if e.weak:
                article[e.number] = article.get(0, 0)
            elif e.chief:
                article[0] = e.number
        top = max((i for i, e in enumerate(path) if e.chief == "main"), default=-1)
        for e in path[: top + 1]:
            if e.weak:
                e.side, e.weak = 0, False
        chains.append((block, weak, article))
    while True:
        free = content = 0
        text: dict[int, int] = {}
        shape: dict[int, int] = {}
        above: dict[int, list[int]] = {}
        articles: dict[tuple[int, int], int] = {}
        for block, weak, article in chains:
            size = len(block.text) - block.linked
            marked = [n for n in weak if made[n].weak]
            if not marked:
                free += size
                content += size * (block.tag not in HEADINGS and any(made[n].side > 0 for n in block.path))
                continue
            inner = marked[-1]
            above[inner] = marked
            text[inner] = text.get(inner, 0) + size
            shape[inner] = shape.get(inner, 0) + (PARAGRAPHS if block.tag == "h1" else block.tag == "p")
            if article.get(inner):
                key = inner, article[inner]
                articles[key] = articles.get(key, 0) + size
        longest: dict[int, int] = {}
        for (n, _), size in articles.items():
            longest[n] = max(longest.get(n, 0), size)
        holds = [(size, n) for n, size in longest.items() if size >= max(free, 1)]
        if not holds and not content:
            holds = [(size, n) for n, size in text.items() if size > MOST * free and shape[n] >= PARAGRAPHS]
        if not holds:
            return
        for n in above[max(holds)[1]]:
            made[n].side, made[n].weak = 0, False


def page_blocks(page: str) -> list[Block]:
    """Blocks of a page in order; white space inside is one space, empty blocks are left out."""
    out: list[Block] = []
    stack: list[_Element] = []
    made: dict[int, _Element] = {}
    parts: list[str] = []
    linked: list[str] = []
    links = number = 0
    at, size = 0, len(page)

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            tag = next((e.tag for e in reversed(stack) if e.tag in BLOCKS), "body")
            inside = len(" ".join(html.unescape("".join(linked)).split()))
            out.append(Block(text, tag, tuple(e.number for e in stack), words=len(text.split()), linked=inside))
        parts.clear()
        linked.clear()

    silent = 0
    while at < size:
        m = _OPENING.search(page, at)
        start = m.start() if m else size
        if start > at and not silent:
            parts.append(page[at:start])
            if links:
                linked.append(page[at:start])
        if not m:
            break
        if m[0] == "<!--":
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        end = page.find(">", start)
        if end < 0:
            break  # a tag that is cut off
        if '"' in (body := page[start:end]) or "'" in body:
            whole = _QUOTED.match(page, start + 1)
            end = whole.end() - 1 if whole else end
        at = end + 1
        if m[0] in ("<!", "<?"):
            continue
        closing = m[0][1] == "/"
        name = _NAME.match(page, start + 1 + closing)
        tag = name[0].lower()
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), -1)
            if tag in BLOCKS:
                flush()
            if depth >= 0:
                del stack[depth:]
                silent = sum(e.silent for e in stack)
            continue
        if tag in BLOCKS:
            flush()
            if stack and stack[-1].tag == "p":
                stack.pop()
            if tag in CLOSED_BY:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in CLOSED_BY[tag]:
                        del stack[i:]
                        break
                    if stack[i].tag in SCOPE:
                        break
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            links += 1
        if tag in EMPTY or page[end - 1] == "/" and tag not in BLOCKS and tag not in SILENT:
            continue
        if tag in RAW:
            close = _CLOSING[tag].search(page, at)
            at = close.end() if close else size
            continue
        attributes = page[name.end() : end]
        if tag in BLOCKS or tag in SILENT or (attributes.strip() and tag != "a"):
            number += 1
            element = _element(tag, attributes, number, any(e.side > 0 for e in stack))
            stack.append(element)
            made[number] = element
            silent += element.silent
    flush()
    if any(e.weak for e in made.values()):
        _lift_weak_marks(out, made)
    for block in out:
        sides = [made[n].side for n in block.path]
        block.side = -1 if -1 in sides else max(sides, default=0)
        block.weak = all(made[n].weak for n in block.path if made[n].side < 0)
    return out


def classify(block: Block) -> float:
    """Above 0: content likelier; the distance from 0 is what the other label costs."""
    words = block.words
    log = words.bit_length() * 0.7
    score = BIAS + PER_LOG_WORD * min(log, 6.0) + LINKS * block.linked / max(len(block.text), 1)
    score += PARAGRAPH * (block.tag in ("p", "blockquote", "pre")) + HEADING * (block.tag in HEADINGS)
    boilerplate = IN_WEAK if block.weak else IN_BOILERPLATE
    return score + (IN_CONTENT if block.side > 0 else boilerplate if block.side < 0 else 0.0)


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges: neighbours on the page, and blocks that follow each other inside an element."""
    found: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        near = {i - 1} if i else set()
        for number in block.path[-2:]:
            if number in last:
                near.add(last[number])
            last[number] = i
        for j in near:
            a, b = blocks[j].path, block.path
            common = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            found[j, i] = int(UNIT * SMOOTH * (common + 1) / (max(len(a), len(b)) + 1))
    return [(a, b, w) for (a, b), w in found.items()]


def minimum_cut(excess: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes end on the source's side. ``excess``: capacity from the source less that to the sink; edges go both ways.

    Flow from nodes with more source than sink to the others, in phases of breadth-first levels and blocking flows.
    """
    n = len(excess)
    excess = list(excess)
    to: list[int] = []
    room: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n)]
    for a, b, w in edges:
        arcs[a].append(len(to))
        to.append(b)
        room.append(w)
        arcs[b].append(len(to))
        to.append(a)
        room.append(w)
    while True:
        level = [0 if e > 0 else -1 for e in excess]
        queue = deque(i for i in range(n) if excess[i] > 0)
        reached = False
        while queue:
            i = queue.popleft()
            if excess[i] < 0:
                reached = True
                continue
            for k in arcs[i]:
                if room[k] > 0 and level[to[k]] < 0:
                    level[to[k]] = level[i] + 1
                    queue.append(to[k])
        if not reached:
            return [x >= 0 for x in level]
        place = [0] * n
        for source in range(n):
            path: list[int] = []
            i = source
            while excess[source] > 0:
                if excess[i] < 0:
                    amount = min([excess[source], -excess[i], *(room[k] for k in path)])
                    excess[source] -= amount
                    excess[i] += amount
                    for k in path:
                        room[k] -= amount
                        room[k ^ 1] += amount
                    path.clear()
                    i = source
                    continue
                while place[i] < len(arcs[i]):
                    k = arcs[i][place[i]]
                    if room[k] > 0 and level[to[k]] == level[i] + 1:
                        break
                    place[i] += 1
                if place[i] < len(arcs[i]):
                    path.append(arcs[i][place[i]])
                    i = to[path[-1]]
                elif path:
                    i = to[path.pop() ^ 1]
                    place[i] += 1
                else:
                    break


def main_text(page: str | None) -> str:
    """The article of a page: content blocks in order, one per line."""
    blocks = page_blocks(page or "")
    if not blocks:
        return ""
    content = minimum_cut([int(UNIT * classify(b)) for b in blocks], edges_of(blocks))
    return "\n".join(b.text for b, keep in zip(blocks, content, strict=True) if keep)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` of every page; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, html_col):
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"]
            )

    frame = pages.select(id_col, url_col, html_col)
    kinds = [frame.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return frame.mapInArrow(run, f"{id_col} {kinds[0]}, {url_col} {kinds[1]}, text string, n_chars bigint")
