"""HTML extraction by tag-path ratios.

A page becomes blocks of text, each with its root-to-leaf path of block tags and
classes. Text length and punctuation are aggregated per path; their ratios to the
path's blocks are smoothed along the page by a Gaussian, averaged per path again,
fused, and paths above a threshold are selected. Links, and names as of menus, adverts
or comments, lower a path's ratio, an article or main element raises it; no name counts
on an element around the leading article. The container that holds most of the selected
text, an article or main element but for its named parts, gives the article: its
selected blocks, and those that belong with them, in page order.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, short_batches

BATCH = 256
#: Share of the mean fused ratio (by text) that a path needs; share of selected text that lets a container go deeper.
THRESHOLD, DEEPER = 0.25, 0.8
#: What an element named as boilerplate multiplies the ratios of its paths by, and an article or main element.
NAMED, LEADING = 0.02, 4.0
#: Elements that are returned whole, and those that are a part of an article among others.
WHOLE, UNDIVIDED = ("article", "main"), ("p", "li", "td", "blockquote", "ul", "ol", "dl", "table", "pre", "h1", "h2", "h3", "h4", "h5", "h6")
#: Paths with this share of text in links, over two blocks or more, are lists of links.
LINKS = 0.6

# Element names of the HTML standard, by their part in a page.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td textarea tfoot th thead title tr ul button".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|template|noscript|iframe|svg|annotation|object|canvas|audio|video|textarea|title|select"
BOILERPLATE = set("head nav footer aside menu dialog button select option optgroup textarea fieldset legend".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side aside menu nav navbar "
    "navigation breadcrumb breadcrumbs footer foot masthead topbar toolbar comment comments commentlist disqus reply replies respond "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login signin search "
    "share sharing social related recommended recommendations trending popular widget widgets pagination pager paging legal copyright "
    "disclaimer skip tags".split()
)
#: Words that go with a name of the above, as in share-bar and site-footer. A class with any other word says nothing.
WITH = set(
    "site page global main top bottom left right primary secondary box block section area list wrap wrapper container inner outer "
    "item items bar panel link links form group row col column unit slot button buttons icons text title heading post article js the".split()
)
HEADER = {"header", "pageheader", "siteheader"}
#: Names of comments that a part of an article may bear, too; they count where like elements repeat.
DISCUSSION = set("discussion discussions response responses reaction reactions feedback conversation conversations guestbook talkback thread threads opinions".split())
#: A short line of a reader's comment.
BYLINE = re.compile(r"\b(?:reply|says|said|wrote|writes|posted|commented|ago|antworten|schrieb|répondre|responder|rispondi)\b|\b\d{1,2}:\d\d\b", re.I)
COMMENTS = re.compile(r"(?:\d+\s+)?(?:(?:reader\s+|user\s+)?comments?|leave a (?:reply|comment)|kommentare?|commentaires?|comentarios?|commenti)\b[\s:.()\d]*|\d+\s+(?:responses?|replies|thoughts)\b.{0,80}", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "td", "th", "article", "section", "main", "body", "html", "div"}

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PART = re.compile(r"[^a-z0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")


@dataclass(slots=True)
class Node:
    tag: str
    path: str
    parent: int
    boiler: bool  # left out, with all within
    article: bool
    named: str = ""  # as boilerplate: "yes", or "maybe" for DISCUSSION


@dataclass(slots=True)
class Block:
    node: int
    text: str
    links: int


def attributes(text: str) -> tuple[str, str, bool, bool]:
    """Class names as a path part, what they name ("yes", "maybe" or nothing), whether a header, whether hidden."""
    names, named, header, hidden = "", "", False, False
    for m in ATTRIBUTE.finditer(text):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            if key == "class":
                names = "." + ".".join(sorted(value.split()))
            for token in value.split():
                parts = {x for x in PART.split(token.rsplit("__", 1)[-1]) if x and not x.isdigit()}
                if parts and parts <= NAMES | WITH | HEADER | DISCUSSION:
                    if parts & NAMES:
                        named = "yes"
                    elif parts & DISCUSSION:
                        named = named or "maybe"
                    header |= bool(parts & HEADER)
        elif key == "role":
            hidden |= value in ROLES
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            hidden = True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return names, named, header, hidden


def blocks_of(page: str) -> tuple[list[Node], list[Block]]:
    """The element tree and the text blocks of a page, in page order."""
    nodes = [Node("", "", -1, False, False)]
    stack, blocks, text, at, link, linked = [0], [], [], 0, 0, 0

    def flush():
        nonlocal text, linked
        if text:
            s = " ".join("".join(text).split())
            if s:
                blocks.append(Block(at, s, min(linked, len(s))))
        text, linked = [], 0

    for m in TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            s = m[0]
            if s[0] != "<" or len(s) == 1:
                if not text:
                    at = stack[-1]
                s = html.unescape(s)
                text.append(s)
                if link:
                    linked += len(s.strip())
            elif m[1] and m[1].lower() not in ("svg", "annotation"):
                text.append(" ") if text else None
            continue
        tag = tag.lower()
        if tag == "a":
            link = 0 if m[2] else 1
            continue
        if tag not in BLOCK:
            if tag == "br" and text:
                text.append(" ")
            continue
        flush()
        link = 0
        if m[2]:  # an end tag closes the nearest open element of its name, if there is one
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    break
            continue
        if nodes[stack[-1]].tag == "p" or nodes[stack[-1]].tag in HEADINGS and tag in HEADINGS:
            stack.pop()
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                t = nodes[stack[k]].tag
                if t in CLOSES[tag]:
                    del stack[k:]
                    break
                if t in SCOPE:
                    break
        if tag in VOID:
            continue
        up = nodes[stack[-1]]
        names, named, header, hidden = attributes(m[4]) if m[4] and not m[4].isspace() else ("", "", False, False)
        whole = tag in ("html", "body", "article", "main")
        boiler = up.boiler or tag in BOILERPLATE or hidden and not whole
        if whole:
            named = ""
        elif tag == "form" or (tag == "header" or header) and not up.article:
            named = "yes"
        nodes.append(Node(tag, f"{up.path}/{tag}{names}{'!' if named else ''}", stack[-1], boiler, up.article or tag in ("article", "main"), named))
        stack.append(len(nodes) - 1)
    flush()
    return nodes, blocks


def weigh(nodes: list[Node], blocks: list[Block]) -> np.ndarray:
    """What each element multiplies the ratios of its paths by."""
    n = len(nodes)
    held, inner = np.zeros(n), [0] * n  # text below; elements below that are named
    for b in blocks:
        if not nodes[b.node].boiler:
            held[b.node] += len(b.text)
    for k in range(n - 1, 0, -1):
        held[nodes[k].parent] += held[k]
    for k in range(1, n):
        inner[k] = inner[nodes[k].parent] + (nodes[k].named == "yes")
    # the leading articles: those in no named element, or else the longest; no name counts on an element around one
    whole = [k for k in range(n) if nodes[k].tag in WHOLE and not nodes[k].boiler and held[k]]
    if whole and all(inner[k] for k in whole):
        k = max(whole, key=lambda k: (held[k], -k))
        while k > 0:
            nodes[k].named = ""
            k = nodes[k].parent
    repeated = comments(nodes, blocks)
    w = np.ones(n)
    lead = np.zeros(n, bool)
    for k in range(1, n):
        x, up = nodes[k], nodes[k].parent
        named = x.named == "yes" or k in repeated and (x.named == "maybe" or repeated[k])
        w[k] = min(w[up], NAMED * max(w[up], 1.0)) if named and w[up] >= 1 else w[up]
        lead[k] = lead[up]
        if x.tag in WHOLE and not lead[k]:
            lead[k] = True
            w[k] *= LEADING
    return w


def comments(nodes: list[Node], blocks: list[Block]) -> dict[int, bool]:
    """The elements that hold like elements of some blocks, and whether most of these have a byline of a comment."""
    own: dict[int, list[Block]] = {}
    for b in blocks:
        own.setdefault(b.node, []).append(b)
    parts: dict[int, list[list]] = {}  # by element: its blocks, whether one is a byline
    children: dict[int, list[int]] = {}
    for k in range(1, len(nodes)):
        children.setdefault(nodes[k].parent, []).append(k)
    for k in range(len(nodes) - 1, -1, -1):
        below = own.get(k, [])
        parts[k] = [len(below) + sum(parts[c][0] for c in children.get(k, ())), any(len(b.text) <= 80 and BYLINE.search(b.text) for b in below) or any(parts[c][1] for c in children.get(k, ()) if nodes[c].tag not in ("p", "li"))]
        if not parts[k][1]:  # a line of its own within the item
            parts[k][1] = any(nodes[c].tag in ("p", "div", "span") and any(len(b.text) <= 80 and BYLINE.search(b.text) for b in own.get(c, [])) for c in children.get(k, ()))
    out = {}
    for k, below in children.items():
        alike: dict[str, list[int]] = {}
        for c in below:
            if nodes[c].tag not in UNDIVIDED or nodes[c].tag == "li":
                alike.setdefault(nodes[c].path, []).append(c)
        for items in alike.values():
            items = [c for c in items if parts[c][0] >= (2 if nodes[c].tag == "li" else 1)]
            if len(items) >= 2:
                lines = sum(parts[c][0] >= 2 and parts[c][1] for c in items)
                out[k] = out.get(k, False) or nodes[k].tag not in (*WHOLE, "body", "html", "") and lines >= 2 and lines >= 0.6 * len(items)
    return out


def muted(nodes: list[Node], blocks: list[Block]) -> list[bool]:
    """Blocks under a heading of readers' comments, up to the next heading of its level beside it."""
    out, under, level = [], -1, 0
    for b in blocks:
        tag, n = nodes[b.node].tag, b.node
        if under >= 0:
            while n > under:
                n = nodes[n].parent
            if n != under or tag in HEADINGS and nodes[b.node].parent == under and int(tag[1]) <= level:
                under = -1
        if under < 0 and tag in HEADINGS and tag != "h1" and COMMENTS.fullmatch(b.text):
            under, level = nodes[b.node].parent, int(tag[1])
        out.append(under >= 0)
    return out


def select(nodes: list[Node], blocks: list[Block]) -> list[Block]:
    """The blocks of the article."""
    weight = weigh(nodes, blocks)
    left = [b for b, m in zip(blocks, muted(nodes, blocks), strict=True) if not m and not nodes[b.node].boiler]
    if not left:
        return []
    paths: dict[tuple[str, float], list] = {}
    of = [paths.setdefault((nodes[b.node].path, weight[b.node]), [len(paths), 0, 0, 0, 0, weight[b.node]]) for b in left]
    for p, b in zip(of, left, strict=True):
        p[1] += 1
        p[2] += len(b.text)
        p[3] += len(PUNCTUATION.findall(b.text))
        p[4] += b.links
    rows = np.array(list(paths.values()), float)
    ids = np.array([p[0] for p in of])
    links = rows[:, 4] / rows[:, 2]
    ratio = np.stack([rows[:, 2] * (1 - links), rows[:, 3]]) / rows[:, 1]
    line = ratio[:, ids]  # each block with its path's ratios, smoothed along the page
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    weights = np.convolve(np.ones(len(ids)), kernel, "same" if len(ids) >= 5 else "full")
    smooth = np.stack([np.convolve(x, kernel, "same" if len(ids) >= 5 else "full") / weights for x in line])
    if len(ids) < 5:
        smooth = smooth[:, 2 : 2 + len(ids)]
    mean = np.stack([np.bincount(ids, s, len(rows)) for s in smooth]) / rows[:, 1]
    fused = np.sqrt(mean[0] * ratio[0]) * (1 + np.sqrt(mean[1] * ratio[1])) * (1 - links) * rows[:, 5]
    chosen = (fused >= THRESHOLD * np.average(fused, weights=rows[:, 2]))[ids]
    listed = ((links > LINKS) & (rows[:, 1] >= 2))[ids]
    # down from the root while one child holds most of the selected text
    held: dict[int, int] = {}
    for b, c in zip(left, chosen, strict=True):
        if c:
            n = b.node
            while n >= 0:
                held[n] = held.get(n, 0) + len(b.text) * weight[b.node]
                n = nodes[n].parent
    inside, down = 0, True
    while down:
        down = False
        for n in held:
            if nodes[n].parent == inside and nodes[inside].tag not in WHOLE and nodes[n].tag not in UNDIVIDED and held[n] >= DEEPER * held[0]:
                inside, down = n, True
                break

    def under(n: int) -> bool:
        while n >= 0:
            if n == inside:
                return True
            n = nodes[n].parent
        return False

    within = np.array([under(b.node) for b in left])
    own = np.array([weight[b.node] for b in left]) >= weight[inside]  # no name between block and container
    # what was not selected: in an article or main element all belongs with it; elsewhere what lies between selected
    # blocks or beside them, and headings there or on the way down
    at = np.flatnonzero(chosen & within)
    among = np.zeros(len(left), bool)
    if len(at):
        among[at[0] : at[-1] + 1] = True
    around, n = set(), inside
    while n >= 0:
        around.add(n)
        n = nodes[n].parent
    beside = {nodes[b.node].parent for b, c in zip(left, chosen, strict=True) if c} - {0}
    around |= beside | {b.node for b, c in zip(left, chosen, strict=True) if c}
    heading = np.array([nodes[b.node].tag in HEADINGS and nodes[b.node].parent in around for b in left])
    sibling = np.array([nodes[b.node].parent in beside and nodes[b.node].tag in UNDIVIDED for b in left])
    belongs = within & own & (np.full(len(left), nodes[inside].tag in WHOLE) | among | sibling) | heading & (own | ~within)
    low = np.array([weight[b.node] < min(1, weight[inside]) for b in left])
    if nodes[inside].tag in WHOLE and (within & own).any():
        chosen = chosen & ~low  # an article or main element says where the article is; what is named has no part in it
    return [b for b, c, x in zip(left, chosen, belongs & ~listed & ~low, strict=True) if c or x]


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in select(*blocks_of(page))) if page else ""


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) per row: the main text of the whole page; null or empty html: empty text.

    Each row is judged by its page alone: repeated rows give equal rows, ids and urls may
    repeat or be null, other columns are ignored, whatever their names. Of containers that
    hold selected text alike the first in the page is taken. An empty table gives an empty one.
    """

    short_batches(pages.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(it, BATCH):
            got = [select(*blocks_of(p)) if p else [] for p in b.column(2).to_pylist()]
            text = ["\n".join(x.text for x in g) for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([len(g) for g in got], pa.int32())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    d = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    return d.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks int")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
