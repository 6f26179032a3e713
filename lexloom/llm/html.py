"""Main text of HTML pages: blocks are labelled content or boilerplate by a minimum cut.

A page is cut into blocks of text. What each label costs a block (the terminal capacities) comes from a classifier of
the block's text and from the names of the elements around it; blocks that follow each other, and blocks that are
children of one element, cost something if their labels differ (the smoothness edges, weaker the further apart in the
tree). The cheapest labelling is a minimum cut, found by maximum flow.

The classifier is a logistic regression on the text features alone. It is fitted on a bounded sample of the pages
(`sample_pages`, smallest hash of the id) whose elements say what is what, so that it also serves pages that don't.

Null and empty pages give an empty text. Names that would leave nothing of a page are not held against it. Repeated rows
give a row each; a tie of two labels goes to boilerplate, unless names were dropped. Very long pages are cut whole. An
empty table gives no rows; only id, url and page are read, so further columns cannot clash. Scripts, styles, forms and other elements that
are never text are left out before. Unclosed elements are closed as browsers do for paragraphs and list items.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.util import arrow_schema, first_by_hash

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title xmp noembed noframes".split())
NEVER = frozenset("head form button select option datalist svg math object canvas audio video map dialog".split()) | RAW
BLOCK = frozenset("""address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li
main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table tr article section div main aside nav footer header body html".split())

AWAY_TAGS = frozenset("nav footer aside header menu".split())
TEXT_TAGS = frozenset("article main".split())
AWAY_NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus discussion footer gdpr
header legal login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup
social sponsor sponsored subscribe subscription tagcloud tags teaser toolbar widget widgets""".split())
TEXT_NAMES = frozenset("article articlebody body content entry main post story text".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())

SURE, NAMED = 12.0, 5.0  # what it costs to go against an element's meaning, and against its name
NEXT_TO, SIBLING = 1.0, 0.6
EVEN = 2.0  # what speaks for text once names are dropped; more than two neighbours can pull
N_FEATURES = 11


@dataclass
class Element:
    tag: str
    number: int
    away: float  # cost of calling the text below it content
    firm: float  # the part of it that does not come from names
    text: float  # cost of calling it boilerplate


@dataclass
class Block:
    text: str
    tag: str
    path: tuple[int, ...]
    away: float
    firm: float
    text_cost: float
    linked: int
    features: list[float] = field(default_factory=list)


def _meaning(tag: str, attributes: str, inside: Element | None) -> tuple[float, float, float]:
    firm, named, text = (inside.firm, inside.away, inside.text) if inside else (0.0, 0.0, 0.0)
    if tag in TEXT_TAGS:
        text = max(text, SURE / 2)
    if tag in AWAY_TAGS:
        # A header or menu of an article is less sure to be one of the page.
        firm = max(firm, NAMED / 2 if tag == "header" and text else SURE)
    for key, *values in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        value, key = "".join(values), key.lower()
        if key == "role":
            if value.lower() in AWAY_ROLES:
                firm = max(firm, SURE)
            if value.lower() in ("main", "article"):
                text = max(text, SURE / 2)
        elif key == "hidden" or key == "aria-hidden":
            if value.lower() in ("", "true", "hidden"):
                firm = max(firm, SURE)
        elif tag not in ("body", "html"):
            names = {n.lower() for n in NAME.findall(value)}
            if names & AWAY_NAMES:
                named = max(named, SURE if not names & TEXT_NAMES else NAMED)
            elif names & TEXT_NAMES:
                text = max(text, NAMED)
    return max(firm, named), firm, text


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, with what the elements around them say."""
    stack: list[Element] = []
    out: list[Block] = []
    parts: list[str] = []
    linked, number, links, at, skipping = 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            # References are decoded last, so what they stand for is never taken as markup.
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                top = stack[-1] if stack else None
                tag = next((e.tag for e in reversed(stack) if e.tag in BLOCK), "")
                out.append(Block(text, tag, tuple(e.number for e in stack if e.tag in BLOCK), top.away if top else 0.0, top.firm if top else 0.0, top.text if top else 0.0, linked))
            parts.clear()
        linked = 0

    def close(i: int) -> None:
        nonlocal skipping, links
        if any(e.tag in BLOCK for e in stack[i:]):
            flush()
        skipping -= sum(e.tag in NEVER for e in stack[i:])
        links -= sum(e.tag == "a" for e in stack[i:])
        del stack[i:]

    def take(a: int, b: int) -> None:
        nonlocal linked
        if b > a and not skipping:
            parts.append(page[a:b])
            if links:
                linked += b - a

    m = MARKUP.search(page)
    while m:
        take(at, m.start())
        at = m.end()
        name = m[2] or m[5]
        if name:
            tag, ends, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if ends:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
            else:
                if tag in BLOCK:
                    for i in range(len(stack) - 1, -1, -1):  # an open paragraph ends here
                        if stack[i].tag == "p":
                            close(i)
                            break
                        if stack[i].tag in BLOCK:
                            break
                if tag in CLOSES:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i].tag in CLOSES[tag]:
                            close(i)
                            break
                        if stack[i].tag in SCOPE and stack[i].tag != "tr" or stack[i].tag == "tr" and tag != "tr":
                            break
                if tag == "body":
                    for i, e in enumerate(stack):  # a head that was never closed
                        if e.tag == "head":
                            close(i)
                            break
                if tag in BLOCK:
                    flush()
                if tag in VOID:
                    if tag == "br" and not skipping:  # other elements without content do not part a word
                        parts.append(" ")
                elif not attributes.endswith("/") or tag in BLOCK or tag in RAW:
                    number += 1
                    stack.append(Element(tag, number, *_meaning(tag, attributes, stack[-1] if stack else None)))
                    skipping += tag in NEVER
                    links += tag == "a"
                    if tag in RAW:  # its content isn't markup
                        end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                        close(len(stack) - 1)
                        at = end.end() if end else len(page)
        m = MARKUP.search(page, at)
    take(at, len(page))
    flush()
    total = max(1, len(out))
    for i, b in enumerate(out):
        t, n = b.text, len(b.text)
        words = t.split(" ")
        b.features = [1.0, np.log1p(n), np.log1p(len(words)), min(1.0, b.linked / n), sum(t.count(c) for c in ".,;:!?") / len(words), float(t[-1] in ".!?:\"'”»…"),
                      n / len(words) / 10, float(b.tag == "p"), float(b.tag[:1] == "h" and b.tag[1:].isdigit()), float(b.tag in ("li", "td", "th")), i / total]
    return out


def fit_classifier(x: np.ndarray, y: np.ndarray, steps: int = 40, l2: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (y - p) - l2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def minimum_cut(text_cost: list[float], away_cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for content. text_cost: of calling a block boilerplate; away_cost: of calling it content; edges: of differing labels."""
    n = len(text_cost)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    lean = [t - a for t, a in zip(text_cost, away_cost)]
    label: list[bool | None] = [None] * n
    # A block that leans further than all its edges can pull is settled; its edges then pull its neighbours.
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(lean[i]) >= sum(near[i].values()):
            label[i] = lean[i] >= 0
            for j, c in near[i].items():
                del near[j][i]
                lean[j] += c if label[i] else -c
                todo.append(j)
            near[i].clear()
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _max_flow(rest, lean, near)):
            label[i] = side
    return [bool(x) for x in label]


def _max_flow(rest: list[int], lean: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Dinic's algorithm; True for the side of the source (content)."""
    at = {i: k for k, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    head: list[list[int]] = [[] for _ in range(len(rest) + 2)]
    to: list[int] = []
    room: list[float] = []

    def edge(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in rest:
        if lean[i] > 0:
            edge(source, at[i], lean[i], 0.0)
        elif lean[i] < 0:
            edge(at[i], sink, -lean[i], 0.0)
        for j, c in near[i].items():
            if i < j:
                edge(at[i], at[j], c, c)
    while True:
        level = [-1] * len(head)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(len(rest))]
        turn, path, u = [0] * len(head), [], source
        while True:
            if u == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                path, u = [], source
            while turn[u] < len(head[u]):
                e = head[u][turn[u]]
                if room[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(head[u]):
                path.append(e)
                u = to[e]
            elif path:
                u = to[path.pop() ^ 1]
                turn[u] += 1
            else:
                break


def main_text(page: str | None, weights: np.ndarray) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    p = 1 / (1 + np.exp(-np.clip(np.array([b.features for b in blocks]) @ weights, -6, 6)))
    text_cost = [b.text_cost - float(np.log(1 - q)) for b, q in zip(blocks, p)]
    away_cost = [2 * b.away - float(np.log(q)) for b, q in zip(blocks, p)]  # what stands in an article may still be away
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1].path
            shared = next((k for k, (x, y) in enumerate(zip(a, b.path)) if x != y), min(len(a), len(b.path)))
            edges.append((i - 1, i, NEXT_TO / (1 + max(0, len(a) + len(b.path) - 2 * shared - 2))))
        parent = b.path[:-1]
        if parent in last:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    label = minimum_cut(text_cost, away_cost, edges)
    if not any(label):  # names that would leave nothing of a page are no evidence
        label = minimum_cut(text_cost, [2 * b.firm - float(np.log(q)) - EVEN for b, q in zip(blocks, p)], edges)
    return "\n\n".join(b.text for b, content in zip(blocks, label) if content)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample_pages: int = 1000) -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    ids = first_by_hash(own.where("html is not null").select("page_id"), "page_id", sample_pages)

    def teach(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page in b.column(0).to_pylist():
                own = blocks_of(page)
                own = [x for x in own if bool(x.away) or bool(x.text_cost)]
                yield pa.RecordBatch.from_arrays([pa.array([x.features for x in own], pa.list_(pa.float64())), pa.array([float(x.text_cost > 2 * x.away) for x in own], pa.float64())], names=["x", "y"])

    got = own.join(F.broadcast(ids), "page_id", "left_semi").select("html").mapInArrow(teach, "x array<double>, y double").toArrow()
    x, y = np.array(got.column("x").to_pylist(), float).reshape(-1, N_FEATURES), got.column("y").to_numpy()
    by = np.lexsort((*x.T, y))
    weights = pages.sparkSession.sparkContext.broadcast(fit_classifier(x[by], y[by]))
    ddl = "page_id long, url string, text string, n_chars long"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, weights.value) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, schema.types[2]), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return own.mapInArrow(run, ddl)
