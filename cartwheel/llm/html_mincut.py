"""Main text of web pages by minimum-cut labelling.

A page is taken apart into text blocks (runs of text between block-level tags),
each with the path of open elements above it. The graph has one node per block
between a source (content) and a sink (boilerplate):

* terminal capacities are classifier costs: a linear score over the block's length
  (against the page's longest text outside boilerplate), its share of link text
  and the names above it gives a probability of being content; labelling
  the block boilerplate costs -log(1 - p_boilerplate), and the other way round;
* smoothness edges join neighbouring blocks and blocks that follow each other
  under one parent; the nearer two blocks are in the element tree the more it
  costs to label them differently. A short paragraph, a bare number or a lone link
  says little by itself: the cut gives it the label of what it stands among.

The cheapest labelling is a minimum cut, found by max-flow (Dinic; flow that
goes straight through one block is removed first, so only disagreements are
left to solve). Content blocks, in page order, make the text.

Pages stay where they are read (no shuffle); a task holds one batch of pages.
A page's graph is linear in its blocks.

Names count by the words of each class, id or role of their own; those that say what
a page has, lacks or is tagged with (``has-sidebar``, ``no-sidebar``, ``tag-social``,
``modal-open``) don't, nor do any on html and body.

Defined cases: null, empty or mark-up-free html is handled (null and empty give
the empty text; plain text is one block, kept however short); unclosed and stray tags
never fail; formulas and drawings are read as text inside their block; an
empty table gives an empty result; repeated rows are repeated; other columns are
not looked at.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Parts of formulas and drawings: their text stands in the line.
DRAWN = frozenset("math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mtable mtr mtd mspace "
                  "mstyle semantics svg g defs use symbol path circle ellipse rect line polyline polygon text tspan".split())
RAW = frozenset("script style noscript template textarea title iframe select button option canvas video audio annotation "
                "annotation-xml desc metadata".split())
CLOSED_BY_PEERS = frozenset("p li dt dd tr td th option".split())
# Log odds of content, by element name and by word of a class, id or role.
CLEAR, LIKELY, HINT = -6.0, -4.0, -2.0
ELEMENT_SCORE = {"article": 0.6, "main": 0.6, "head": CLEAR, "address": HINT} | dict.fromkeys("nav footer aside form menu dialog".split(), CLEAR)
WORD_SCORE = (
    dict.fromkeys("content article post entry story main body text".split(), 0.3)
    | dict.fromkeys("nav navigation navbar menu breadcrumb breadcrumbs masthead banner footer sidebar aside complementary contentinfo "
                    "ad ads adv advert adverts advertisement sponsor sponsored promo promoted cookie cookies consent gdpr notice "
                    "notification popup modal overlay newsletter subscribe subscription signup login comment comments replies disqus "
                    "toolbar pagination pager copyright".split(), CLEAR)
    | dict.fromkeys("header search alert reply respond discussion related recommended share sharing social widget skip legal "
                    "disclaimer hidden".split(), LIKELY)
    | {"tags": HINT, "byline": -0.5})
# Names that begin or end so tell of the page, not of the element.
ABOUT_PAGE = re.compile(r"(?:no|not|has|have|with|without|is|tag|category|cat|tax|term|js|type|format|status|layout)[-_].*"
                        r"|.*[-_](?:open|opened|closed|enabled|disabled|active|visible|loaded|layout|template|page)")
SCALE = 100                  # capacities are integers
SMOOTH = 3.0                 # cost of splitting two blocks of one element

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_NAME = re.compile(r"[a-z]+")
_SPLIT = re.compile(r"[\s,]+")


class Element:
    __slots__ = ("name", "parent", "depth", "score", "in_content", "number")

    def __init__(self, name: str, parent: Element | None, score: float, number: int):
        self.name, self.parent, self.number = name, parent, number
        self.depth = parent.depth + 1 if parent else 0
        self.in_content = name in ("article", "main") or bool(parent and (parent.in_content or score > parent.score))
        self.score = score


def _name_score(value: str) -> float:
    """Of a class, id or role: the clearest word of its names."""
    scores = [WORD_SCORE.get(w, 0.0) for name in _SPLIT.split(value) if not ABOUT_PAGE.fullmatch(name) for w in _NAME.findall(name)]
    least = min(scores, default=0.0)
    return least if least < 0 else max(scores, default=0.0)


def _own_score(name: str, attributes: str, parent: Element | None) -> float:
    score = ELEMENT_SCORE.get(name, 0.0)
    if name == "header":     # a page's header, not an article's title block
        score = -0.5 if parent and parent.in_content else CLEAR
    for key, value in _ATTRIBUTE.findall(attributes) if attributes and name not in ("html", "body") else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "style":
            score += CLEAR if "display:none" in value.replace(" ", "") else 0.0
        elif key in ("hidden", "aria-hidden"):
            score += CLEAR if value != "false" else 0.0
        else:
            score += _name_score(value)
    return score


class Block:
    __slots__ = ("parent", "text", "linked")

    def __init__(self, parent: Element, text: str, linked: int):
        self.parent, self.text, self.linked = parent, text, linked


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks with the innermost block element above each."""
    root = Element("", None, 0.0, 0)
    stack, blocks, pieces, linked, links, number = [root], [], [], 0, 0, 0
    open_names: Counter[str] = Counter()

    def end_block():
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                blocks.append(Block(stack[-1], text, linked))
            pieces.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        if raw:
            pieces.append(raw)
            if links:
                linked += len(raw)

    at, n = 0, len(page)
    while at < n:
        token = _TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        add(page[at:token.start()])
        at = token.end()
        name = token[2]
        if name is None:         # comment or declaration
            continue
        name, closing = name.lower(), token[1]
        if name == "a":
            links = 0 if closing else 1
        if name == "br":
            pieces.append(" ")
        elif name in INLINE or name in DRAWN:
            pass
        elif closing:
            end_block()
            while open_names[name]:          # a stray end tag closes nothing
                open_names[stack[-1].name] -= 1
                links = 0
                if stack.pop().name == name:
                    break
        elif name in RAW:
            if not token[3].endswith("/"):
                end_block()
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
        else:
            end_block()
            if name in VOID:
                continue
            if stack[-1].name == "p" or name in CLOSED_BY_PEERS and stack[-1].name == name:      # a block element ends a paragraph
                open_names[stack.pop().name] -= 1
            number += 1
            open_names[name] += 1
            stack.append(Element(name, stack[-1], stack[-1].score + _own_score(name, token[3], stack[-1]), number))
    end_block()
    return blocks


def longest_text(blocks: list[Block]) -> int:
    """Length of the longest block that no name above speaks against."""
    return max((len(b.text) - b.linked for b in blocks if b.parent.score >= -0.5), default=0)


def content_score(block: Block, longest: int) -> float:
    """Log odds of the block being content. Its length counts against a fifth of
    the page's longest text (against 20 characters, if that is more): a page of
    short texts is no less a page."""
    n = len(block.text)
    measure = max(0.5, min(20.0, longest / 5))
    score = block.parent.score + 0.9 * (min(4.0, math.log1p(n / measure)) - 1.0) - 3.5 * min(1.0, block.linked / n)
    if block.parent.name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption", "td", "th", "li", "dt", "dd"):
        score += 0.2
    return score


def content_cost(block: Block, longest: int) -> tuple[int, int]:
    """(cost of labelling it boilerplate, cost of labelling it content)."""
    score = content_score(block, longest)
    softplus = lambda x: max(0.0, x) + math.log1p(math.exp(-abs(x)))
    return round(SCALE * softplus(score)), round(SCALE * softplus(-score))


def distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def smoothness_edges(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(i, j, capacity): neighbours by their distance in the tree, and each
    block with the next one of the same parent's element. Where the names above
    two blocks differ in what they say, there is a border to be expected."""
    def capacity(a: Block, b: Block, steps: int) -> int:
        return round(SCALE * SMOOTH / ((1 + steps) * (1 + abs(a.parent.score - b.parent.score))))

    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i and (c := capacity(blocks[i - 1], b, distance(blocks[i - 1].parent, b.parent))):
            edges.append((i - 1, i, c))
        above = (b.parent.parent or b.parent).number
        if above in last and last[above] != i - 1 and (c := capacity(blocks[last[above]], b, 2)):
            edges.append((last[above], i, c))
        last[above] = i
    return edges


def min_cut(keep: list[int], drop: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The cheapest labelling: a block labelled content costs ``drop``, one not
    labelled so costs ``keep``, an edge whose ends differ its capacity. True:
    content (ties: content)."""
    n = len(keep)
    excess = [k - d for k, d in zip(keep, drop)]
    if all(e >= 0 for e in excess) or all(e < 0 for e in excess):
        return [e >= 0 for e in excess]
    to, room, out = [], [], [[] for _ in range(n + 2)]
    source, sink = n, n + 1

    def arc(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, e in enumerate(excess):
        if e > 0:
            arc(source, i, e, 0)
        elif e < 0:
            arc(i, sink, -e, 0)
    for i, j, c in edges:
        arc(i, j, c, c)
    while True:
        level = _levels(out, to, room, source)
        if level[sink] < 0:
            break
        _block_flow(out, to, room, level, source, sink)
    # Content: what the sink can't be reached from; a tie goes to content.
    reach, todo = [False] * (n + 2), deque([sink])
    reach[sink] = True
    while todo:
        v = todo.popleft()
        for a in out[v]:
            if room[a ^ 1] and not reach[to[a]]:
                reach[to[a]] = True
                todo.append(to[a])
    return [not reach[i] for i in range(n)]


def _levels(out, to, room, source) -> list[int]:
    level, todo = [-1] * len(out), deque([source])
    level[source] = 0
    while todo:
        v = todo.popleft()
        for a in out[v]:
            if room[a] and level[to[a]] < 0:
                level[to[a]] = level[v] + 1
                todo.append(to[a])
    return level


def _block_flow(out, to, room, level, source, sink) -> None:
    """Saturate the level graph, one path at a time (iterative)."""
    tried = [0] * len(out)
    path: list[int] = []
    v = source
    while True:
        if v == sink:
            flow = min(room[a] for a in path)
            cut = len(path)
            for k, a in enumerate(path):
                room[a] -= flow
                room[a ^ 1] += flow
                if not room[a] and k < cut:
                    cut = k
            v = to[path[cut] ^ 1]
            del path[cut:]
            continue
        while tried[v] < len(out[v]):
            a = out[v][tried[v]]
            if room[a] and level[to[a]] == level[v] + 1:
                break
            tried[v] += 1
        if tried[v] < len(out[v]):
            path.append(a)
            v = to[a]
        elif v == source:
            return
        else:
            a = path.pop()
            v = to[a ^ 1]
            tried[v] += 1


def main_text(page: str | None) -> tuple[str, int, int]:
    """(text, blocks kept, blocks found) of one page."""
    blocks = blocks_of(page or "")
    if not blocks:
        return "", 0, 0
    longest = longest_text(blocks)
    costs = [content_cost(b, longest) for b in blocks]
    kept = min_cut([c[0] for c in costs], [c[1] for c in costs], smoothness_edges(blocks))
    parts = [b.text for b, k in zip(blocks, kept) if k]
    return " ".join(parts), len(parts), len(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept for every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([len(f[0]) for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32()),
                 pa.array([f[1] for f in found], pa.int32())],
                ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_blocks int, n_kept int")
