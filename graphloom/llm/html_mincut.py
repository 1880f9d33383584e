"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text.  A linear classifier gives each a cost for
being content and one for being boilerplate; they become the capacities to the
two terminals.  It is fitted to a sample of pages that name their article: over
what a block says, its length, links and ending, and over what the elements
around it say, which is one hint among others and never certain.  Neighbours in
the page and under one container are tied, the stronger the more alike they
are: in tag, path, links and length.  The minimum cut labels all blocks of the
page at once: a short line among paragraphs is content, and a whole sentence
among links isn't, by what they are tied to and not by themselves.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import tuned

# Fixed values of HTML: elements by their role.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title noscript template svg math iframe object select option textarea button datalist canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset search".split())
CONTENT_TAGS = frozenset("article main".split())
#: Words in class, id and role names; comments and adverts in some other languages as well.
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus footer form header legal login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promotion promoted recommended related remark replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets anzeige anzeigen anuncio anuncios comentario comentarios commentaire commentaires kommentar kommentare publicidad publicite werbung".split()
)
CONTENT_NAMES = frozenset("article articlebody body content entry main post prose story text".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Words of a block of neutral length.
NEUTRAL = 10
#: Features of a block: any, share of linked text, length, an end like that of a sentence, a paragraph or heading, the copyright sign; and of the elements around: the nearest one that says anything says content (less so the deeper), or boilerplate; none says content though another element of the page does.
TEXT, FEATURES = 6, 9
#: Weights before any page is seen, how much it costs to leave them, and their bound.
PRIOR = (-0.5, -2.0, 1.0, 0.5, 0.5, -2.0, 4.0, -4.0, -2.0)
SPREAD, MOST = 1.0, 6.0
#: Pages and blocks of the sample that the weights are fitted to, and the length of its pages.
SAMPLE_PAGES, SAMPLE_BLOCKS, SAMPLE_CHARS = 400, 40_000, 200_000
#: Smoothness between blocks in a row and under the same container, and what is left of it between regions and, of a content hint, a level further down.
TIE_NEXT, TIE_PARENT, ACROSS, FADE = 0.3, 0.3, 0.25, 0.9
#: What makes neighbours unlike: linked share, length, tag, path.
UNLIKE = (2.0, 1.0, 1.0, 2.0)
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre body #root".split())


class Element:
    __slots__ = ("tag", "parent", "hint", "region", "depth", "hidden", "path", "article")

    def __init__(self, tag: str, parent: Element | None, attrs: str) -> None:
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.hidden = tag in HIDDEN or bool(parent and parent.hidden)
        above = parent.hint if parent else 0
        own = hint(tag, attrs, above) if parent and tag not in ("html", "body") else 0
        # the region is the nearest element that says anything
        self.region = self if own or not parent else parent.region
        self.hint = own or above
        self.path = hash((parent.path if parent else 0, tag, attrs))
        self.article = tag == "article" and own > 0 or bool(parent and parent.article and own >= 0)


def hint(tag: str, attrs: str, above: int) -> int:
    """What an element says of the text in it, over what stands above it: 1 for content, -1 for boilerplate, 0 for nothing."""
    names = {w.lower() for m in _NAMES.finditer(attrs) for w in _WORD.findall(m.group(1))} if attrs else set()
    boiler, content = names & BOILER_NAMES, names & CONTENT_NAMES
    if boiler and not content or tag in BOILER_TAGS:
        return -1
    if tag == "header":
        return 0 if above > 0 else -1
    if tag in CONTENT_TAGS or content and not boiler:
        return 1 if above >= 0 else 0
    return 0


class Block:
    __slots__ = ("text", "parent", "linked")

    def __init__(self, text: str, parent: Element, linked: int) -> None:
        self.text, self.parent, self.linked = text, parent, linked


def blocks(source: str) -> list[Block]:
    """The visible texts between block-level tags, in page order, with character references decoded and white space as one space."""
    top = here = Element("#root", None, "")
    out: list[Block] = []
    runs: list[str] = []
    linked, in_link, at = 0, False, 0

    def close() -> None:
        nonlocal linked
        if runs:
            text = " ".join("".join(runs).split())
            if text:
                out.append(Block(text, here, linked))
            runs.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not here.hidden:
            text = html.unescape(raw) if "&" in raw else raw
            runs.append(text)
            if in_link:
                linked += len(text.strip())

    end = len(source)
    while at < end:
        m = _MARKUP.search(source, at)
        if not m:
            add(source[at:])
            break
        add(source[at : m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag in BLOCK or tag in HIDDEN:
                up = here
                while up is not top and up.tag != tag:
                    up = up.parent
                if up is not top:
                    close()
                    here, in_link = up.parent, False
                elif tag == "p":
                    close()
            elif tag == "a":
                in_link = False
            continue
        if tag == "br":
            runs.append(" ")
        elif tag == "a":
            in_link = True
        elif tag in VOID:
            if tag == "hr":
                close()
        elif tag in BLOCK or tag in HIDDEN:
            close()
            in_link = False
            # a block ends an open paragraph, an item ends an open item
            ends = {"p"} if tag in BLOCK else set()
            if tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
                ends |= {"li"} if tag == "li" else {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag, "td", "th"}
            while here.tag in ends:
                here = here.parent
            here = Element(tag, here, m.group(3) or "")
            if tag in RAW:
                stop = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = stop.end() if stop else end
                here = here.parent
    close()
    return out


def length_of(b: Block) -> float:
    """From -1 to 1, 0 for a block of neutral length."""
    words = b.text.count(" ") + 1
    return max(-1.0, min(1.0, math.log((1 + words) / (1 + NEUTRAL)) / math.log(1 + NEUTRAL)))


def features(found: list[Block]) -> list[list[float]]:
    """FEATURES of each block of a page, the first TEXT of them of the block alone."""
    named = any(b.parent.region.hint > 0 for b in found)
    out = []
    for b in found:
        region = b.parent.region
        own = [1.0, min(1.0, b.linked / len(b.text)), length_of(b), float(b.text[-1] in ".!?…\"'”»"), float(b.parent.tag in TEXT_TAGS), float(b.text[0] == "©")]
        around = [FADE ** (b.parent.depth - region.depth) if region.hint > 0 else 0.0, float(region.hint < 0), float(named and region.hint <= 0)]
        out.append(own + around)
    return out


def likeness(a: Block, b: Block, x: list[float], y: list[float]) -> float:
    """1 for neighbours of one kind, less the more their links, lengths, tags and paths differ."""
    unlike = (abs(x[1] - y[1]), abs(x[2] - y[2]), float(a.parent.tag != b.parent.tag), float(a.parent.path != b.parent.path))
    return math.exp(-sum(w * d for w, d in zip(UNLIKE, unlike)))


def min_cut(content: list[float], boiler: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: the side that reaches no sink in the residual graph of a maximum flow.

    content and boiler are capacities from the source and to the sink; ties are
    undirected.  Dinic's algorithm; a node that both terminals can reach at no
    cost is boilerplate.
    """
    n = len(content)
    give = [max(0.0, a - b) for a, b in zip(content, boiler)]
    take = [max(0.0, b - a) for a, b in zip(content, boiler)]
    to: list[int] = []
    cap: list[float] = []
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b, c in ties:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += (b, a)
        cap += (c, c)
    tiny = 1e-12
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if give[i] > tiny)
        for i in queue:
            level[i] = 0
        found = False
        while queue:
            v = queue.popleft()
            found |= take[v] > tiny
            for e in near[v]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if not found:
            return [x >= 0 for x in level]
        place = [0] * n
        for s in range(n):
            while level[s] == 0 and give[s] > tiny:
                path: list[int] = []
                v = s
                while take[v] <= tiny:
                    while place[v] < len(near[v]):
                        e = near[v][place[v]]
                        if cap[e] > tiny and level[to[e]] == level[v] + 1:
                            break
                        place[v] += 1
                    if place[v] < len(near[v]):
                        path.append(near[v][place[v]])
                        v = to[path[-1]]
                    elif path:
                        e = path.pop()
                        v = to[e ^ 1]
                        place[v] += 1
                    else:
                        break
                if take[v] <= tiny:
                    break
                push = min([give[s], take[v], *(cap[e] for e in path)])
                give[s] -= push
                take[v] -= push
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push


def _speaks(x: list[float], weights) -> float:
    """How much speaks for content."""
    return sum(v * w for v, w in zip(x, weights))


def graph(found: list[Block], weights=PRIOR) -> tuple[list[float], list[float], list[tuple[int, int, float]]]:
    """(capacities from the source, to the sink, smoothness edges) of the blocks."""
    x = features(found)
    z = [_speaks(v, weights) for v in x]
    ties: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        home = id(b.parent.parent or b.parent)
        for j, tie in ((i - 1, TIE_NEXT), (last.get(home, -1), TIE_PARENT)):
            if j >= 0:
                ties.append((j, i, tie * likeness(found[j], b, x[j], x[i]) * (1.0 if found[j].parent.region is b.parent.region else ACROSS)))
        last[home] = i
    return [max(v, 0.0) for v in z], [max(-v, 0.0) for v in z], ties


def labelled(source: str, weights=PRIOR) -> list[tuple[str, bool, bool]]:
    """(text, content by what it says alone, content by the cut) of each block of a page."""
    found = blocks(source)
    keep = min_cut(*graph(found, weights))
    return [(b.text, _speaks(x[:TEXT], weights) > 0, k) for b, x, k in zip(found, features(found), keep)]


def main_text(source: str, weights=PRIOR) -> str:
    return " ".join(text for text, _, keep in labelled(source, weights) if keep)


def fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights by logistic regression, near PRIOR where pages say little.

    Each block counts twice: as it is, and as if its page had no tags and names,
    so that what a block says has weights of its own.
    """
    prior = np.array(PRIOR)
    if not len(y) or y.all() or not y.any():
        return PRIOR
    bare = x.copy()
    bare[:, [4, *range(TEXT, FEATURES)]] = 0.0
    x, y = np.concatenate([x, bare]), np.concatenate([y, y]).astype(float)
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both labels weigh the same
    beta = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = (x * (share * p * (1 - p))[:, None]).T @ x + SPREAD * len(y) / 200 * np.eye(FEATURES)
        step = np.linalg.solve(slope, x.T @ (share * (p - y)) + SPREAD * len(y) / 200 * (beta - prior))
        beta = np.clip(beta - step, -MOST, MOST)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(beta.tolist())


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y) of the blocks of pages that name their article."""
    for b in batches:
        xs, ys = [], []
        for page in b.column(0).to_pylist():
            found = blocks(page)
            inside = [x.parent.article for x in found]
            if any(inside):
                xs += features(found)
                ys += inside
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.bool_())], ["x", "y"])


def learned(pages: DataFrame) -> tuple[float, ...]:
    """Weights fitted to about SAMPLE_PAGES pages, taken by a hash of url and html, that hold an article element; PRIOR where there are none."""
    n = pages.count()
    short = pages.select(F.col("url").cast("string"), F.col("html").cast("string")).filter(F.length("html").between(1, SAMPLE_CHARS))
    few = short.filter(F.pmod(F.xxhash64("url", "html"), F.lit(1 << 20)) < min(1 << 20, math.ceil(SAMPLE_PAGES / max(1, n) * (1 << 20)))).filter(F.lower("html").contains("<article"))
    got = few.select("html").mapInArrow(_training, "x array<double>, y boolean").limit(SAMPLE_BLOCKS).collect()
    return fitted(np.array([r.x for r in got]).reshape(-1, FEATURES), np.array([r.y for r in got], bool))


def extracted(pages: DataFrame, weights=None) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages.

    text is the content blocks in page order, joined by one space; empty if
    there are none, and for null or empty html.  The classifier is fitted to a
    bounded sample of the pages, unless its weights are given.  Whole pages are
    read, of any length and however broken: what is open at the end closes
    there.  Repeated rows stay; other columns are ignored; an empty table gives
    no rows.
    """
    tuned(pages.sparkSession)
    weights = tuple(learned(pages) if weights is None else weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(t.as_py() or "", weights) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
