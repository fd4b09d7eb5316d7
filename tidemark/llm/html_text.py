"""Main text of HTML pages by minimum-cut labelling of blocks."""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, column, small_batches, table

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mstyle mover munder".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup to read: skipped whole.
RAW = frozenset("script style title textarea noscript template iframe svg object xmp noembed noframes".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HELD = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote td dd dt".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button select option fieldset head".split())
CONTENT = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class or id that mark page furniture.
CUES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side-?bar|rail|widgets?|comments?|commentlist|respond|replies|disqus|footer|foot|header|masthead|navbar|nav|navigation|menu|breadcrumbs?|cookies?|consent|gdpr|notice|notification|alert|popup|pop-?up|modal|overlay|newsletter|subscribe|signup|sign-?up|login|share|sharing|social|related|recommended|pagination|pager|toolbar|skip-?link|legal|copyright|hidden)(?:$|[\s_-]|\d)",
    re.I,
)
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

#: Capacities of the smoothness edges: between blocks that follow each other, and between successive blocks of a parent.
ADJACENT, SIBLING = 0.5, 1.5
#: About how many pages, chosen by a hash of the page, the block classifier is fitted on, and the most blocks of them.
FIT_PAGES, FIT_BLOCKS = 400, 40_000
#: Ridge of the fit: weights of what always tells end near its logarithm.
RIDGE = 1e-5
#: Where the features of a block's place begin among features().
PLACES = 5
#: Used where the sample does not hold both kinds of blocks. Order as in features().
DEFAULT_WEIGHTS = (-2.0, 0.9, -4.0, 1.0, 0.5, -12.0, 12.0, -6.0)


class Block:
    __slots__ = ("cue", "links", "parent", "tag", "text")

    def __init__(self, text: str, links: int, tag: str, parent: int, cue: int):
        self.text, self.links, self.tag, self.parent, self.cue = text, links, tag, parent, cue

    def features(self, any_article: bool) -> tuple[float, ...]:
        """Bias, length, share of links, punctuation, an end mark, and the place: in what names or tags call furniture,
        in the article, or outside of it on a page that has one."""
        n = self.text.count(" ") + 1
        ends = sum(map(self.text.count, ".!?;:,"))
        place = (float(self.cue < 0), float(self.cue > 0), float(any_article and self.cue == 0))
        return (1.0, math.log1p(n), self.links / max(1, len(self.text)), min(1.0, ends / n * 4), 1.0 if self.text[-1:] in ".!?\"”»" else 0.0, *place)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order: white space inside a block is one space, references are decoded."""
    out: list[Block] = []
    # open elements: (name, number, cue) where cue is -1 in furniture, 1 in the article, 0 elsewhere; where each name
    # and the elements that are no inline ones stand, and how many articles are open
    stack: list[tuple[str, int, int]] = [("", 0, 0)]
    open_by_name: dict[str, list[int]] = {}
    open_blocks = [0]
    articles = 0
    serial = 0
    parts: list[str] = []
    links = 0
    in_link = 0
    pos, end = 0, len(page)

    def close_to(depth: int) -> None:
        nonlocal articles
        while len(stack) > depth:
            name = stack.pop()[0]
            open_by_name[name].pop()
            if open_blocks[-1] == len(stack):
                open_blocks.pop()
            articles -= name in CONTENT

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                k = open_blocks[-1]
                # paragraphs stand under the element that holds them
                parent = stack[k - 1][1] if k and stack[k][0] in HELD else stack[k][1]
                out.append(Block(text, links, stack[k][0], parent, stack[-1][2]))
            parts.clear()
        links = 0

    def text(piece: str) -> None:
        nonlocal links
        piece = html_lib.unescape(piece) if "&" in piece else piece
        parts.append(piece)
        if in_link:
            links += len(piece)

    while pos < end:
        at = page.find("<", pos)
        if at < 0:
            text(page[pos:])
            break
        if at > pos:
            text(page[pos:at])
        if page.startswith("<!--", at):
            close = page.find("-->", at + 2)
            pos = end if close < 0 else close + 3
            continue
        if page.startswith(("<!", "<?"), at):
            close = page.find(">", at)
            pos = end if close < 0 else close + 1
            continue
        m = TAG.match(page, at)
        if not m:
            nxt = page[at + 1 : at + 3]
            if nxt[:1].isalpha() or (nxt[:1] == "/" and nxt[1:2].isalpha()):  # a tag that never closes its quotes
                close = page.find(">", at)
                pos = end if close < 0 else close + 1
            else:
                text("<")
                pos = at + 1
            continue
        pos = m.end()
        closing, name, attrs = m[1], m[2].lower(), m[3]
        if name == "br" or name == "hr":
            text(" ")
            if name == "hr":
                flush()
            continue
        if closing:
            held = open_by_name.get(name)
            if name not in INLINE:
                flush()
            if held and (name not in INLINE or open_blocks[-1] < held[-1]):
                close_to(held[-1])
            if name == "a":
                in_link = 0
            continue
        if name in RAW:
            if not attrs.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, pos)
                if close:
                    shut = page.find(">", close.end())
                    pos = end if shut < 0 else shut + 1
                else:
                    pos = end
            continue
        if name in VOID:
            continue
        if name not in INLINE:
            flush()
            inner = open_blocks[-1]
            if inner and (stack[inner][0] == "p" or stack[inner][0] in SAME.get(name, ())):
                close_to(inner)
        elif name == "a":
            in_link = 1
        cue = stack[-1][2]
        got = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTR.findall(attrs)} if attrs.strip() else {}
        named = f"{got.get('class', '')} {got.get('id', '')}"
        if cue >= 0:
            if name in CONTENT:
                cue = 1
            bad = (name in FURNITURE and not (name == "header" and articles)) or got.get("role", "").lower() in ROLES or "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", got.get("style", ""), re.I)
            if bad or (name not in ("body", "html", "article", "main") and CUES.search(named)):
                cue = -1
        serial += 1
        open_by_name.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            open_blocks.append(len(stack))
        articles += name in CONTENT
        stack.append((name, serial, cue))
    flush()
    return out


def min_cut(content: list[float], furniture: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the content side of a minimum cut.

    content[i] is lost if i is cut off as furniture, furniture[i] if it stays; an edge's capacity if it is severed.
    A node whose terminals differ by more than all its edges can weigh takes its side in every minimum cut; it is taken
    out and its edges go to its neighbours' terminals, until none is left (most pages end there). Maximum flow decides
    the rest.
    """
    n = len(content)
    score = [a - b for a, b in zip(content, furniture, strict=True)]
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a].append((b, c))
            near[b].append((a, c))
    weight = [sum(c for _, c in x) for x in near]
    keep: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if keep[i] is None and abs(score[i]) > weight[i]:
            keep[i] = score[i] > 0
            for j, c in near[i]:
                if keep[j] is None:
                    score[j] += c if keep[i] else -c
                    weight[j] -= c
                    queue.append(j)
    left = [i for i in range(n) if keep[i] is None]
    if left:
        place = {i: k for k, i in enumerate(left)}
        inner = [(place[a], place[b], c) for a, b, c in edges if a in place and b in place and a != b and c > 0]
        for i, kept in zip(left, _max_flow_side([score[i] for i in left], inner), strict=True):
            keep[i] = kept
    return [bool(k) for k in keep]


def _max_flow_side(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The source side of a minimum cut where score is the surplus of the source's terminal, by blocking flows."""
    n = len(score)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, s in enumerate(score):
        if s > 0:
            link(source, i, s, 0.0)
        elif s < 0:
            link(i, sink, -s, 0.0)
    for a, b, c in edges:
        link(a, b, c, c)
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and to[e] not in level:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if sink not in level:
            return [i in level for i in range(n)]
        nth = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nth[a] < len(out[a]):
                e = out[a][nth[a]]
                if room[e] > 1e-9 and level.get(to[e]) == level[a] + 1:
                    break
                nth[a] += 1
            if nth[a] < len(out[a]):
                path.append(out[a][nth[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                a = to[path.pop() ^ 1]
                nth[a] += 1


def main_text(page: str | None, weights=DEFAULT_WEIGHTS) -> str:
    """The article's text, '' if there is none.

    Each block's score, from a logistic classifier of its length, links, punctuation and place in the page, gives its
    terminal capacities; neighbouring blocks and successive blocks of one parent are tied by smoothness edges; the
    minimum cut decides.
    """
    found = blocks(page or "")
    if not found:
        return ""
    any_article = any(b.cue > 0 for b in found)
    score = [sum(w * x for w, x in zip(weights, b.features(any_article), strict=True)) for b in found]
    edges = [(k, k + 1, ADJACENT) for k in range(len(found) - 1)]
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        if b.parent in last:
            edges.append((last[b.parent], k, SIBLING))
        last[b.parent] = k
    keep = min_cut([max(0.0, x) for x in score], [max(0.0, -x) for x in score], edges)
    return " ".join(b.text for b, kept in zip(found, keep, strict=True) if kept)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Weights of x beside the offset, by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w + offset, -30, 30)))
        grad = x.T @ (weight * (y - p)) - RIDGE * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_weights(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic weights of features() x, from blocks whose place tells whether they are of the article (y).

    Both kinds weigh the same in sum. What a block says is fitted first and alone, as it must do on pages whose names
    tell nothing; then what its place adds to that. Words in names mark furniture that is none now and then, so the
    place's weight is learned; the ridge keeps it finite. What no block shows is not learned.
    """
    if len(y) < 50 or min(y.sum(), len(y) - y.sum()) < 10:
        return DEFAULT_WEIGHTS
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    says, place = x[:, :PLACES], x[:, PLACES:]
    w = _logistic(says, y, weight, np.zeros(len(y)))
    w = np.concatenate([w, _logistic(place, y, weight, says @ w)])
    return tuple(float(v) if seen else d for v, seen, d in zip(w, x.any(axis=0), DEFAULT_WEIGHTS, strict=True))


def sample_blocks(pages: DataFrame, fit_pages: int = FIT_PAGES) -> tuple[np.ndarray, np.ndarray]:
    """(features, of the article) of the blocks that teach: on pages with an article all, on others what is furniture.

    From about fit_pages pages chosen by a hash of the page, at most FIT_BLOCKS blocks in the order of those hashes; so
    reruns agree, and numbers alone reach the driver. pages: html.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batched(batches):
            rows: list[list] = [[], [], []]
            for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = blocks(page)
                any_article = any(x.cue > 0 for x in found)
                for x in found:
                    if any_article or x.cue:
                        for col, v in zip(rows, (h, x.features(any_article), x.cue > 0), strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.list_(pa.float64())), pa.array(rows[2], pa.bool_())], ["h", "x", "y"])

    rows = pages.where("html is not null").select(F.xxhash64("html").alias("h"), "html")
    part = min(1.0, fit_pages / max(1, rows.count()))
    chosen = rows.where(F.pmod("h", F.lit(1 << 20)) < int(part * (1 << 20)) + 1).mapInArrow(run, "h long, x array<double>, y boolean")
    found = chosen.orderBy("h", "x").limit(FIT_BLOCKS).toArrow()
    x = np.array(found.column("x").to_pylist(), dtype=float).reshape(found.num_rows, len(DEFAULT_WEIGHTS))
    return x, found.column("y").to_numpy(zero_copy_only=False).astype(float)


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", fit_pages=FIT_PAGES) -> DataFrame:
    """page_id, url, text, n_chars; one row per input row.

    Null and empty html give the empty text, as do pages without a content block; an empty table gives no rows. Each
    page is read whole, in time linear in its length but for the flow among blocks that the classifier leaves open.
    Rows that repeat are extracted alike; columns but the three named are not read, so extra ones can't clash. The
    block classifier is fitted on a bounded sample; everything else is local to a page, so memory is that of a batch.
    """
    small_batches(pages.sparkSession)
    base = pages.select(column(id_col).cast("long").alias("page_id"), column(url_col).cast("string").alias("url"), column(html_col).cast("string").alias("html"))
    weights = fit_weights(*sample_blocks(base.select("html"), fit_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches):
            texts = [main_text(x, weights) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return base.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
