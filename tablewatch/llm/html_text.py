"""Main text of web pages by the host's consensus path.

First pass: every page is parsed in one linear scan. Parts that are never the article (menus, page headers,
footers, side columns, notices, adverts, forms, scripts, styles, reader comments, lists of links) are left
out; of the containers left, the page chooses the deepest one that still holds most of the text. Its
generalised tag-class path is the page's vote. Spark adds up the votes of each host. Second pass: every page
is extracted again with its host's winning path; a page on which that path holds less than half of what the
page's own choice holds keeps its own choice, so an odd page of a host is not lost.

Blocks come out in page order, whole: character references decoded, white space in a block (a line break
included) turned into one space, trimmed, joined by one line feed.

Rows: null or empty html gives an empty text. A null url is a host of its own; a null page_id and repeated
rows are kept as they are. Broken markup is read as browsers do: an unmatched end tag is ignored, an unclosed
element ends with its parent. Extra columns are ignored; an empty table gives an empty result. Ties go to the
heavier, then the smaller path.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewatch.llm.shared import written

MOST = 0.8  # share of a page's text that its chosen container holds
BODY_FORM = 0.8  # a form with this share of a page's text is the page's frame, not an entry form
LINKS = 0.6  # a part with this share of its text in links is a menu
MAX_BROADCAST_HOSTS = 200_000  # a row of about 100 bytes each
MAX_PATH = 400  # longer paths continue as a digest

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.DOTALL)
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")  # after a quote that never closes
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
_NUMBER = re.compile(r"[0-9]+")
_HOST = re.compile(r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")

# Elements by what they are in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noframes xmp".split())
JUNK = frozenset("nav footer aside form button select option datalist dialog menu template svg math object audio video canvas map head".split())
CONTAINERS = frozenset("body main article section div td center ul ol dl table figure details blockquote".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li pre th tr dt dd address figcaption summary hr header hgroup thead tbody tfoot caption html fieldset legend".split())
LISTS = frozenset("ul ol div dl table section".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HELD_BY = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
JUNK_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb"
    " breadcrumbs sidebar footer masthead cookie cookies consent gdpr banner notice popup modal overlay newsletter subscribe subscription"
    " signup login share sharing social related recommended comment comments respond replies disqus widget toolbar pagination pager"
    " disclaimer skip topbar".split()
)
CONTENT_NAMES = frozenset("article content entry main post story text body page".split())
ARTICLES = frozenset(("article", "main"))
FRAMES = frozenset("body main article section div td center table".split())  # what a page's main container can be
HEADINGS = frozenset(("h1", "h2"))
JUNK_HEADERS = frozenset(("header", "site-header", "page-header", "siteheader", "pageheader", "top-header"))


@dataclass
class Page:
    """Blocks of text, each with its innermost container, and the containers with their parents."""

    blocks: list[tuple[str, int]]
    parent: list[int]
    path: list[str]
    text: list[int]  # characters below each container
    kept: list[bool]  # no link list around it
    tags: list[str]  # of the containers
    heading: int  # container of the first heading, -1 without one


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(source)} if source.strip(" /") else {}


def _is_junk(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    if tag in JUNK or (tag == "header" and not inside_article):
        return True
    if not attributes:
        return False
    style = attributes.get("style", "").replace(" ", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style or attributes.get("role", "").lower() in JUNK_ROLES:
        return True
    if tag in ("body", "html", "main", "article"):
        return False
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    if any(w in JUNK_NAMES or w in JUNK_HEADERS for w in names):
        return True
    # a compound is junk by its head (comment-list, not no-sidebar), unless another name says that it is the content
    heads = [next(filter(None, _SPLIT.split(w)), "").lower() for w in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()]
    return any(w in JUNK_NAMES for w in heads) and not any(w in CONTENT_NAMES for w in names)


def _step(tag: str, attributes: dict[str, str]) -> str:
    names = sorted({_NUMBER.sub("#", w) for w in attributes.get("class", "").split()})
    return ".".join([tag, *names])


def parse(source: str) -> Page:
    """The page's blocks and containers. A form around most of the text is read as a plain container."""
    page, in_forms, left_out = _scan(source, frozenset())
    total = page.text[0] + left_out
    frames = frozenset(k for k, size in in_forms.items() if size >= BODY_FORM * total > 0)
    return _scan(source, frames)[0] if frames else page


def _scan(source: str, plain_forms: frozenset[int]) -> tuple[Page, dict[int, int], int]:
    """One scan over the page; every tag is pushed and popped at most once.

    Also the characters in each form that is left out, by the form's number, and in all parts that are left out.
    """
    page = Page([], [-1], [""], [0], [True], ["html"], -1)
    in_forms: dict[int, int] = {}
    forms, form, left_out = 0, -1, 0  # forms so far; the one that is being left out
    linked, tags = [0], page.tags
    inside = [False]  # an article
    stack: list[tuple[str, int]] = []  # open elements: tag, container outside it
    opened: Counter[str] = Counter()
    parts: list[str] = []
    size = link_size = 0
    here, skip, at = 0, -1, 0  # container; depth of the open element that is left out; position

    def flush() -> None:
        nonlocal size, link_size
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                page.blocks.append((text, here))
                page.text[here] += len(text)
                linked[here] += min(len(text), link_size) if size else 0
            parts.clear()
        size = link_size = 0

    def pop() -> None:
        nonlocal here, skip
        tag, outside = stack.pop()
        opened[tag] -= 1
        if tag in BLOCKS and skip < 0:
            flush()
        here = outside
        if len(stack) == skip:
            skip = -1

    def text(piece: str, coded: bool = True) -> None:
        nonlocal size, link_size, left_out
        if piece and skip >= 0:
            seen = len(piece) - piece.count(" ") - piece.count("\n")
            left_out += seen
            if form >= 0:
                in_forms[form] = in_forms.get(form, 0) + seen
        elif piece:
            parts.append(entities.unescape(piece) if coded and "&" in piece else piece)
            size += len(piece)
            if opened["a"] > 0:
                link_size += len(piece)

    end, last_mark, tag_at = len(source), source.rfind(">"), _TAG
    while at < end:
        start = source.find("<", at)
        if start < 0:
            text(source[at:])
            break
        text(source[at:start])
        m = None
        if source.startswith(("<!", "<?"), start):
            m = _TAG.match(source, start)
        elif start < last_mark:
            m = tag_at.match(source, start)
            if not m and tag_at is _TAG and _LOOSE_TAG.match(source, start):
                tag_at = _LOOSE_TAG
                m = tag_at.match(source, start)
        if not m:
            text("<")
            at = start + 1
            continue
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"), coded=False)
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag in BLOCKS and skip < 0:
                flush()
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(source, at)
            at = close.end() if close else end
            continue
        if tag in BLOCKS and opened["p"] > 0 and skip < 0:
            while stack[-1][0] != "p":
                pop()
            pop()
        if tag in CLOSES:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] not in CLOSES[tag] and stack[k][0] not in HELD_BY[tag] and stack[k][0] not in CONTAINERS:
                k -= 1
            if k >= 0 and stack[k][0] in CLOSES[tag]:
                while len(stack) > k:
                    pop()
        attributes = _attributes(m[3])
        if tag in BLOCKS and skip < 0:
            flush()
        forms += tag == "form"
        if skip < 0:
            form = -1
            if not (tag == "form" and forms in plain_forms) and _is_junk(tag, attributes, opened["article"] > 0 or opened["main"] > 0):
                skip = len(stack)
                form = forms if tag == "form" else -1
        if tag in HEADINGS and skip < 0 and page.heading < 0:
            page.heading = here
        stack.append((tag, here))
        opened[tag] += 1
        if tag in CONTAINERS and skip < 0:
            path = f"{page.path[here]}>{_step(tag, attributes)}"
            page.path.append(path if len(path) <= MAX_PATH else "#" + hashlib.md5(path.encode()).hexdigest())
            page.parent.append(here)
            page.text.append(0)
            page.kept.append(True)
            linked.append(0)
            tags.append(tag)
            inside.append(inside[here] or tag in ARTICLES)
            here = len(page.path) - 1
    while stack:
        pop()
    flush()
    own = list(page.text)
    for c in range(len(own) - 1, 0, -1):
        page.text[page.parent[c]] += page.text[c]
        linked[page.parent[c]] += linked[c]
    for c in range(1, len(own)):
        menu = not inside[c] and tags[c] in LISTS and linked[c] >= LINKS * page.text[c] > 0 and 2 * page.text[c] < page.text[0]
        page.kept[c] = page.kept[page.parent[c]] and not menu
    page.text = [0] * len(own)
    page.blocks = [b for b in page.blocks if page.kept[b[1]]]
    for block, c in page.blocks:
        page.text[c] += len(block)
    for c in range(len(own) - 1, 0, -1):
        page.text[page.parent[c]] += page.text[c]
    return page, in_forms, left_out


def _below(page: Page, top: int) -> list[bool]:
    out = [c == top for c in range(len(page.path))]
    for c in range(top + 1, len(out)):
        out[c] = out[c] or out[page.parent[c]]
    return out


def choice(page: Page) -> int:
    """The deepest container with most of the text (0: the whole page), not below an article and not past the first heading."""
    best, around = 0, set()
    c = page.heading
    while c > 0:
        around.add(c)
        c = page.parent[c]
    for c in range(1, len(page.path)):
        if page.tags[best] in ARTICLES:
            break
        if page.parent[c] == best and page.tags[c] in FRAMES and page.text[c] >= MOST * page.text[0] > 0:
            if page.tags[c] not in ARTICLES and around and c not in around:
                continue
            best = c
    return best


def main_text(page: Page, winner: str | None) -> str:
    """Text below the host's path; if that leaves out a block of the page's own choice, the own choice."""
    own = _below(page, choice(page))
    holds = [False] * len(page.path)
    for c in range(len(page.path)):
        holds[c] = (c > 0 and holds[page.parent[c]]) or page.path[c] == winner
    if winner is None or any(own[c] and not holds[c] for _, c in page.blocks):
        holds = own
    return "\n".join(b for b, c in page.blocks if holds[c])


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: Counter[tuple[str, str]] = Counter()
        weight: Counter[tuple[str, str]] = Counter()
        for url, source in zip(batch.column(0), batch.column(1), strict=True):
            page = parse(source.as_py() or "")
            if page.text[0]:
                c = choice(page)
                key = (host(url.as_py()), page.path[c])
                votes[key] += 1
                weight[key] += page.text[c]
        keys = list(votes)
        yield pa.record_batch(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
             pa.array([votes[k] for k in keys], pa.int64()), pa.array([weight[k] for k in keys], pa.int64())],
            names=["host", "path", "votes", "weight"],
        )


def consensus(pages: DataFrame) -> DataFrame:
    """(host, winner): the path most of a host's pages chose."""
    votes = pages.select("url", "html").mapInArrow(_votes, "host string, path string, votes long, weight long")
    total = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("weight").alias("weight"))
    return written(total.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), -F.col("weight"), "path")).alias("winner")))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(parse(h.as_py() or ""), w.as_py()) for h, w in zip(batch.column("html"), batch.column("winner"), strict=True)]
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    winners = consensus(pages)
    if winners.count() <= MAX_BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    name = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1))
    return (
        pages.withColumn("host", name).join(winners, "host", "left")
        .select("page_id", "url", "html", "winner")
        .mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
    )
