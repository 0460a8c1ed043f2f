"""Main text of HTML pages by minimum-cut labelling.

A page is cut into blocks of text at block-level tags. A naive Bayes classifier over the look of a block
(length, links, punctuation, tag) and the meaning of its ancestors (article, nav, class names) give the
cost of calling it content or boilerplate: the capacities to the two terminals. Edges between neighbours
in the page, and between blocks of the same parent, are the price of a change of label. The minimum cut,
by maximum flow, separates content from boilerplate.

What the classifier says of a block is bounded by LOOK, below what an ancestor says (MEANING), so the looks of a
long comment or a short item do not outweigh the element that it stands in; a block without such an ancestor is
decided by the cut, from its look and its neighbours. Items of lists and cells of tables are short by nature:
unless they are mostly links they have no cost of their own, and go with what stands around their list or table.

The classifier is trained here, on at most SAMPLE distinct pages (by a hash of the page), from blocks whose
ancestors tell what they are. The rest is a map over pages: no shuffle, one page in memory at a time.

Defined results: null and empty pages give empty text; null and repeated ids are rows of their own;
unclosed tags, comments and scripts end with the page; an empty table gives an empty result; other columns
are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import hashed_share

#: Pages that the classifier is trained on, at most.
SAMPLE = 2_000
#: Cost of a label that the ancestors speak against, the most that the look of a block may cost, and the cost of a
#: change of label between neighbours in the page and, in addition, between blocks of one parent.
MEANING, LOOK, NEXT, SIBLING = 4.0, 2.0, 0.8, 2.0
SCALE = 1000

TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<svg\b(?>[^>"']|"[^"<]*"|'[^'<]*')*+(?<=/)>
    |<(?P<raw>script|style|noscript|template|textarea|svg|annotation|annotation-xml|iframe|object|select|button|title)\b(?>[^>"']|"[^"<]*"|'[^'<]*')*+>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>[^>"']|"[^"<]*"|'[^'<]*')*+|[^>]*)(?:>|\Z)""",
    re.S | re.I | re.X,
)
MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# HTML's block-level elements, void elements and elements with a meaning.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAVES = frozenset("p li dd dt td th pre blockquote h1 h2 h3 h4 h5 h6 figcaption caption summary".split())
#: Where items and cells stand: they are neighbours of what stands around these.
GROUPS = frozenset("dl ol table tbody tfoot thead tr ul".split())
ITEMS = frozenset("dd dt li td th".split())
OUTSIDE = frozenset("aside dialog dir fieldset footer form head header legend menu nav".split())
INSIDE = frozenset("article main".split())
#: An open element of these is closed by a new one of the same set.
CLOSES = ({"p"}, {"li"}, {"dt", "dd"}, {"td", "th"}, {"tr"}, {"option"})
OUT_WORDS = frozenset("ad ads advert advertisement advertorial adverts alert author-box banner bottombar breadcrumb breadcrumbs bylinks comment comments complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus footer form gdpr header masthead menu menubar meta-nav modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup privacy promo promoted promotion reader-comments recommend recommended related reply replies respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe tags taglist teaser toc toolbar topbar widget".split())
#: Elements and names whose articles are comments or teasers, not the page's own.
ASIDE = frozenset("aside comment comments complementary contentinfo dialog disqus footer menu nav reader-comments recommend recommended related replies reply respond sidebar teaser".split())
#: Parts of a compound class name that make the others tell of something beside or absent.
BESIDE = frozenset("has have no not non with without".split())
IN_WORDS = frozenset("article article-body articlebody content-body entry-content main-content mainbody post-body post-content story story-body".split())


@dataclass
class Block:
    text: str
    parent: int
    tag: str
    meaning: int
    linked: int
    form: int = 0
    item: bool = False
    features: tuple[str, ...] = field(default=())


def _meaning(name: str, attrs: str, before: int) -> int:
    """1: holds content, -1: holds none, -2: holds none, nor do articles in it, 0: says nothing. ``before``: what the
    element around it says; the header of an article is part of it. Elements that hold content speak by their tag
    and by whole names only."""
    if before == -2 and name != "main":
        return 0
    headline = name == "header" and before > 0
    if name in OUTSIDE and not headline:
        return -2 if name in ASIDE else -1
    said = 1 if name in INSIDE else 0
    if "=" in attrs and name not in ("html", "body"):
        for m in MARK.finditer(attrs):
            names = (m[1] or m[2] or m[3] or "").lower().split()
            split = {n: re.split(r"[-_]+", n) for n in names}
            parts = {x for n, xs in split.items() for x in ((n,) if name in INSIDE or BESIDE.intersection(xs) else (n, *xs))}
            if out := (parts - {"header", "masthead"} if headline else parts) & OUT_WORDS:
                return -2 if out & ASIDE else -1
            if parts & IN_WORDS:
                said = 1
    return said


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order. The nearest ancestor that says something decides; the header of an article
    says nothing, nor does a form around most of the page's text."""
    found: list[Block] = []
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # name, number, meaning, the form that gave it
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked, in_link, numbers, last = 0, 0, 0, 0

    def close() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                # a leaf that says something else than its parent is no sibling of the parent's blocks
                own, up = stack[-1], len(stack) - 1
                while up and stack[up - 1][2] == own[2] and (stack[up][0] in GROUPS or stack[up][0] in LEAVES and (up == len(stack) - 1 or stack[up][0] in ITEMS)):
                    up -= 1
                item = any(x[0] in ITEMS for x in stack[up + 1 :])
                found.append(Block(text, stack[up][1], own[0], max(own[2], -1), linked, own[3], item))
            pieces, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if in_link:
                linked += len(text)

    for m in TOKEN.finditer(page):
        if m.start() > last:
            add(page[last : m.start()])
        last = m.end()
        name = m["name"]
        if name is None:
            raw = m["raw"]
            if raw:
                add(" ") if raw.lower() not in ("title",) else close()
            elif m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if name == "a":
            in_link = 0 if m["end"] else 1
        elif name == "br":
            add(" ")
        elif name in BLOCKS:
            close()
            in_link = 0
            if m["end"]:
                if opened[name]:
                    while (gone := stack.pop()[0]) != name:
                        opened[gone] -= 1
                    opened[name] -= 1
            elif name not in VOID:
                for group in CLOSES:
                    if name in group and stack[-1][0] in group:
                        opened[stack.pop()[0]] -= 1
                if name != "p" and stack[-1][0] == "p":
                    opened[stack.pop()[0]] -= 1
                before = stack[-1][2]
                said = _meaning(name, m["attrs"] or "", before)
                numbers += 1
                opened[name] += 1
                form = numbers if name == "form" else 0 if said else stack[-1][3]
                stack.append((name, numbers, said or before, form))
    if last < len(page):
        add(page[last:])
    close()
    sizes = Counter()
    for b in found:
        sizes[b.form] += len(b.text)
    for b in found:
        if b.form and 2 * sizes[b.form] >= sizes.total():
            b.meaning = 0
        b.features = look(b)
    return found


def look(b: Block) -> tuple[str, ...]:
    """What the classifier sees of a block."""
    n = len(b.text)
    share = b.linked / n
    return (
        "tag:" + ("h" if re.fullmatch("h[1-6]", b.tag) else b.tag if b.tag in ("p", "li", "td", "div", "article", "section", "dd", "dt", "blockquote", "pre") else "other"),
        "size:" + str(min(8, n.bit_length())),
        "links:" + ("0" if share == 0 else "1" if share < 0.33 else "2" if share < 0.66 else "3"),
        "end:" + ("1" if b.text[-1] in ".!?:;\"'”’»)" else "0"),
        "stops:" + str(min(3, b.text.count(". ") + b.text.count(", "))),
    )


#: Counts (content, other) that training starts from, so that a corpus without telling ancestors has a model.
START = {"links:3": (1, 8), "links:2": (1, 4), "links:0": (4, 2), "size:1": (1, 3), "size:2": (1, 3), "size:8": (8, 1), "tag:p": (6, 2), "tag:li": (2, 4), "tag:h": (3, 2), "stops:3": (6, 1), "end:1": (6, 3), "end:0": (2, 5)}


def weights(counts: dict[tuple[str, int], int]) -> dict[str, float]:
    """Log odds of content for each feature, of naive Bayes with add-one counts, damped for the features'
    overlap; from counts by (feature, label)."""
    total = Counter()
    for f in {f for f, _ in counts} | set(START):
        for label in (0, 1):
            total[f.split(":")[0], label] += counts.get((f, label), 0) + START.get(f, (0, 0))[1 - label] + 1
    out = {}
    for f in {f for f, _ in counts} | set(START):
        kind = f.split(":")[0]
        one, zero = (counts.get((f, label), 0) + START.get(f, (0, 0))[1 - label] + 1 for label in (1, 0))
        out[f] = 0.5 * math.log(one / total[kind, 1] * total[kind, 0] / zero)
    return out


def max_flow_cut(source: list[int], sink: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut. source, sink: capacities of the terminal edges;
    edges: undirected capacities. Nodes whose terminals outweigh all their edges are decided first, which no
    minimum cut contradicts; for the others, all shortest paths of a breadth-first search are filled in one
    sweep, again and again (blocking flows), so that long pages take little more than a few sweeps."""
    n = len(source)
    excess = [a - b for a, b in zip(source, sink, strict=True)]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), c in edges.items():
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        k = todo.popleft()
        if label[k] is None and abs(excess[k]) >= sum(near[k].values()) and excess[k]:
            label[k] = excess[k] > 0
            for j, c in near[k].items():
                del near[j][k]
                excess[j] += c if label[k] else -c
                todo.append(j)
            near[k] = {}
    left = [k for k in range(n) if label[k] is None]
    room = {k: dict(near[k]) for k in left}
    inflow, outflow = {k: max(0, excess[k]) for k in left}, {k: max(0, -excess[k]) for k in left}
    while True:
        level = {k: 0 for k in left if inflow[k] > 0}
        queue, starts, open_end = deque(level), list(level), False
        while queue:
            k = queue.popleft()
            open_end |= outflow[k] > 0
            for j, c in room[k].items():
                if c > 0 and j not in level:
                    level[j] = level[k] + 1
                    queue.append(j)
        if not open_end:
            return [level_or is True if level_or is not None else k in level for k, level_or in enumerate(label)]
        arcs, tried = {k: list(room[k]) for k in level}, dict.fromkeys(level, 0)
        for start in starts:
            path = [start]
            while path and inflow[start] > 0:
                k = path[-1]
                if outflow[k] > 0:
                    push = min(inflow[start], outflow[k], *[room[a][b] for a, b in pairwise(path)])
                    inflow[start] -= push
                    outflow[k] -= push
                    for a, b in pairwise(path):
                        room[a][b] -= push
                        room[b][a] += push
                    full = next((n for n, (a, b) in enumerate(pairwise(path)) if not room[a][b]), len(path) - 1)
                    del path[full + 1 :]
                elif tried[k] < len(arcs[k]):
                    j = arcs[k][tried[k]]
                    if room[k][j] > 0 and level.get(j) == level[k] + 1:
                        path.append(j)
                    else:
                        tried[k] += 1
                else:
                    path.pop()
                    if path:
                        tried[path[-1]] += 1


def looks(b: Block, odds: dict[str, float]) -> float:
    """What the classifier says of a block: above 0 for content."""
    if b.item and 2 * b.linked < len(b.text):
        return 0.0
    return max(-LOOK, min(LOOK, sum(odds.get(f, 0.0) for f in b.features)))


def extract(page: str, odds: dict[str, float]) -> str:
    """The content blocks of a page, joined by an empty line."""
    found = blocks(page)
    cost = [MEANING * b.meaning + looks(b, odds) for b in found]
    edges: dict[tuple[int, int], int] = {}
    latest: dict[int, int] = {}
    for k, b in enumerate(found):
        if k:
            edges[k - 1, k] = round(NEXT * SCALE)
        if b.parent in latest:
            pair = (latest[b.parent], k)
            edges[pair] = edges.get(pair, 0) + round(SIBLING * SCALE / math.sqrt(k - latest[b.parent]))
        latest[b.parent] = k
    keep = max_flow_cut([round(max(0.0, c) * SCALE) for c in cost], [round(max(0.0, -c) * SCALE) for c in cost], edges)
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = Counter()
        for page in batch.column("html").to_pylist():
            for b in blocks(page or ""):
                if b.meaning:
                    seen.update((f, int(b.meaning > 0)) for f in b.features)
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], names=["feature", "label", "n"])


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """The classifier's log odds from at most ``sample`` pages."""
    some = pages.select(F.col(html_col).cast("string").alias("html")).filter("html is not null").withColumn("h", F.xxhash64("html"))
    picked = some.filter(hashed_share(F.col("h"), 0.9 * sample / max(1, some.count()))).dropDuplicates(["h"]).limit(sample)
    counted = picked.select("html").mapInArrow(_count, "feature string, label int, n long")
    return weights({(r["feature"], r["label"]): r["n"] for r in counted.groupBy("feature", "label").agg(F.sum("n").alias("n")).collect()})


def _extract(batches: Iterator[pa.RecordBatch], odds: dict[str, float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py() or "", odds) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    odds = train(pages, html_col, sample)
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = own.schema["page_id"].dataType.simpleString()
    return own.mapInArrow(lambda it: _extract(it, odds), f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
