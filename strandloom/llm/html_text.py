"""HTML extraction: the main text of a page, block by block.

A page is cut into its leaf blocks, each with the path of open elements that leads
to it; a bidirectional LSTM (``block_labeller``) labels every block in the context of
all others; the text is that of the blocks labelled main, in page order.

The labeller is trained here, on ``TRAIN_PAGES`` pages of ``TRAIN_CHARS`` characters at most (those with the
smallest hash of their page_id and url), which are the bound of what reaches the driver. The
pages have no labels; training labels come from the markup. Inside ``nav``, ``aside``, ``form``
or an element whose class says advert or comment is furniture. Main is what else stands inside ``article`` or
``main``; a page without them is read by where its text is: from the body
inwards, as long as one box holds most of the unlinked text that is not furniture, and main is what that
box holds. Each page is also shown in variants, with other names for the main element and with further
furniture around and inside it, so that the labeller does not depend on one layout.

Pages are read in time proportional to their length. A ``>`` inside quotes does not end a tag; where
quotes leave a tag without an end, the next ``>`` ends it; after the last ``>`` of a page all is text. Of an element's
class, id and role the first ``NAMES`` words count, and of a block's open elements the outermost and innermost ``DEPTH``.

Defined cases: null and empty html give an empty text; references are decoded;
white space (line breaks and non-breaking spaces too) becomes one space inside a
block; ``<br>`` is white space; an unclosed comment or script runs to the page's end; a
``<`` that opens no tag is text; repeated rows give equal texts; an empty table
gives an empty result, and without pages to train on no block is main.
"""

from __future__ import annotations

import html
import re
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .block_labeller import Block, Page, scores, trained
from .common import table

TRAIN_PAGES = 200
TRAIN_CHARS = 500_000
NAMES = 16
DEPTH = 24
#: Variants that are shown in all, shared out among the pages.
VARIANTS = 400

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_SIBLING = frozenset("p li dt dd option tr td th h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("ul ol dl table tbody thead tr div section article main body aside nav header footer form blockquote".split())
UNREAD = frozenset("script style noscript template svg iframe textarea select".split())
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
TAG_MARK = re.compile("[>\"']")
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Za-z]+")


def _tag_end(page: str, at: int, lost: set[int]) -> int:
    """Where the tag that opens before ``at`` ends: the next > outside quotes, or else the next one.

    ``lost`` holds the quotes, read as opening ones, from which a scan has found no end; one that reaches such a
    quote has none either, so no part of a page is scanned more than once for nothing.
    """
    i, tried = at, []
    while (m := TAG_MARK.search(page, i)) and m.start() not in lost:
        if m[0] == ">":
            return m.start()
        tried.append(m.start())
        i = page.find(m[0], m.end()) + 1
        if not i:
            break
    lost.update(tried)
    return page.index(">", at)


def tokens(page: str):
    """(text, None, False, "") and ("", tag, whether it closes, attributes) in turn; comments and unread elements leave."""
    at, look, last = 0, 0, page.rfind(">")
    closing: dict[str, re.Pattern] = {}
    lost: set[int] = set()
    while True:
        i = page.find("<", look)
        if i < 0:
            break
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            end, tag = (end + 3 if end >= 0 else len(page)), None
        elif i > last:
            break
        elif page.startswith(("<!", "<?"), i):
            end, tag = page.index(">", i) + 1, None
        elif m := TAG.match(page, i):
            stop = _tag_end(page, m.end(), lost)
            end, tag = stop + 1, m[2].lower()
            if tag in UNREAD:
                if not m[1]:
                    close = closing.setdefault(tag, re.compile(rf"</{tag}\s*>", re.I)).search(page, end)
                    end = close.end() if close else len(page)
                tag = None
        else:
            look = i + 1
            continue
        if i > at:
            yield page[at:i], None, False, ""
        if tag:
            yield "", tag, bool(m[1]), page[m.end() : stop]
        at = look = end
    if at < len(page):
        yield page[at:], None, False, ""


class Stack:
    """The open elements; whatever closes some costs no more than opening them did."""

    def __init__(self):
        self.own: list[tuple[str, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.boxes: list[int] = []

    def top(self) -> str:
        return self.own[-1][0] if self.own else ""

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.own))
        if tag in CONTAINERS:
            self.boxes.append(len(self.own))
        self.own.append((tag, names))

    def cut(self, size: int) -> None:
        while len(self.own) > size:
            tag, _ = self.own.pop()
            self.places[tag].pop()
            if tag in CONTAINERS:
                self.boxes.pop()

    def close(self, tag: str) -> None:
        """Closes the innermost such element; what is no container closes only inside its own container."""
        places = self.places.get(tag)
        if places and (tag in CONTAINERS or not self.boxes or places[-1] > self.boxes[-1]):
            self.cut(places[-1])

    def path(self) -> tuple[str, ...]:
        own = self.own if len(self.own) <= 2 * DEPTH else self.own[:DEPTH] + self.own[-DEPTH:]
        return tuple(x for _, names in own for x in names)


def blocks(page: str | None) -> list[Block]:
    """The page's blocks that hold text, in order."""
    out: list[Block] = []
    stack, pieces = Stack(), []
    linked = in_link = 0
    for text, tag, closes, attributes in tokens(page or ""):
        if tag is None:
            pieces.append(text)
            if in_link:
                linked += len(text)
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not closes
            elif tag == "br":
                pieces.append(" ")
            continue
        _block(out, stack, pieces, linked)
        pieces, linked, in_link = [], 0, 0
        if closes:
            stack.close(tag)
            continue
        if tag in CLOSED_BY_SIBLING or tag in CONTAINERS:
            if stack.top() == "p":
                stack.cut(len(stack.own) - 1)
            if stack.top() == tag and tag in CLOSED_BY_SIBLING:
                stack.cut(len(stack.own) - 1)
        if tag not in VOID:
            names = [f"{name.lower()[0]}:{x.lower()}" for name, *values in NAMED.findall(attributes) for x in PART.findall("".join(values))]
            stack.push(tag, (tag, *names[:NAMES]))
    _block(out, stack, pieces, linked)
    return out


def _block(out: list[Block], stack: Stack, pieces: list[str], linked: int) -> None:
    raw = "".join(pieces)
    text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
    if text:
        out.append(Block(stack.path(), text, min(linked, len(text))))


#: Names of furniture in class, id and role.
FURNITURE = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo cookie cookies consent notice alert popup modal newsletter subscribe signup login search sidebar side menu nav navigation navbar breadcrumb breadcrumbs "
    "header masthead footer comment comments reply replies disqus share social related recommended widget toolbar tags pagination complementary contentinfo dialog copyright".split()
)
FURNITURE_TAGS = frozenset("nav aside footer form header button dialog menu head title".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = ["article", "main", "div c:content", "div c:post", "div i:article", "div c:article c:body", "section c:story", "div c:entry c:content", "div r:main", "div i:content", "div c:main c:content", "div c:post c:body"]
FURNITURE_NAMES = sorted(FURNITURE_TAGS - {"head", "title"}) + [f"{{}}:{name}" for name in sorted(FURNITURE)]
KINDS = ["div c", "section i", "div r", "ul c", "div i", "section c"]
LEAVES = ["p", "li", "div", "h2", "h3", "span", ""]


#: Elements that can hold a whole article.
BOXES = frozenset("html body div section article main center table tbody tr td".split())
#: The share of the text that one box must hold to be looked into.
MOST_TEXT = 0.7


def furniture(block: Block) -> bool:
    """Whether the markup says that the block is not main text."""
    return bool(FURNITURE_TAGS & set(block.path)) or bool(FURNITURE & {x[2:] for x in block.path if x[1:2] == ":"})


def roles(page: list[Block]) -> np.ndarray:
    """1 for each block that the markup, or where the page's text stands, says is main."""
    open_ = [i for i, b in enumerate(page) if not furniture(b)]
    stated = [i for i in open_ if MAIN_TAGS & set(page[i].path)]
    if not stated:
        stated, depth = open_, 0
        while True:
            held: dict[tuple[str, ...], int] = {}
            for i in stated:
                path = page[i].path
                if depth < len(path) and path[depth] in BOXES:
                    end = next((k for k in range(depth + 1, len(path)) if path[k][1:2] != ":"), len(path))
                    held[path[:end]] = held.get(path[:end], 0) + len(page[i].text) - page[i].linked
            box = max(held, key=held.get, default=())
            if not box or held[box] < MOST_TEXT * sum(len(page[i].text) - page[i].linked for i in stated):
                break
            stated, depth = [i for i in stated if page[i].path[: len(box)] == box], len(box)
    out = np.zeros(len(page), np.float32)
    out[stated] = 1
    return out


def variant(page: list[Block], rng: np.random.Generator, texts: list[Block]) -> tuple[list[Block], np.ndarray]:
    """The page with another main element and more furniture, and its labels."""
    name = tuple(MAIN_NAMES[rng.integers(len(MAIN_NAMES))].split())
    wrap = tuple(["div"] * int(rng.integers(0, 3)))
    fitting = lambda: tuple(FURNITURE_NAMES[rng.integers(len(FURNITURE_NAMES))].format(KINDS[rng.integers(len(KINDS))]).split())

    def more(inside: tuple[str, ...]):
        for _ in range(int(rng.integers(0, 3))):
            own = fitting()
            for _ in range(int(rng.integers(1, 6))):
                text = texts[rng.integers(len(texts))]
                out.append(Block((*inside, *wrap, *own, *LEAVES[rng.integers(len(LEAVES))].split()), text.text, int(rng.random() < 0.4) * len(text.text)))
                labels.append(0)

    out: list[Block] = []
    labels: list[int] = []
    body = ("html", "body")
    more(body)
    inside = False
    known = roles(page) > 0
    held = [b.path for b, main in zip(page, known) if main]
    box = commonprefix(held) if held else ()
    for b, main in zip(page, known.tolist()):
        if main != inside:
            more(body)
            inside = main
        if main:
            at = next((i for i, x in enumerate(b.path) if x in MAIN_TAGS), None)
            leaf = b.path[at + 1 :] if at is not None else b.path[min(len(box), len(b.path) - 1) :]
            if leaf == ("p",) and rng.random() < 0.2:
                leaf = tuple(["h2", "ul li", "ol li", "blockquote p", "div", "section p"][rng.integers(6)].split())
            b = b._replace(path=(*body, *wrap, *name, *leaf))
            if rng.random() < 0.04:
                more((*body, *wrap, *name))
        out.append(b)
        labels.append(int(main))
    more(body)
    return out, np.array(labels, np.float32)


def sample(pages: DataFrame, most: int = TRAIN_PAGES) -> list[str]:
    """``most`` pages at most, the same in every run.

    Hashes are compared first, so tasks send the driver hashes, not pages.
    """
    keyed = pages.where((F.length("html") > 0) & (F.length("html") <= TRAIN_CHARS)).select("html", F.xxhash64("page_id", "url", F.length("html")).alias("order"))
    chosen = [r.order for r in keyed.select("order").distinct().orderBy("order").limit(most).collect()]
    rows = keyed.where(F.col("order").isin(chosen)).groupBy("order").agg(F.min("html").alias("html")).orderBy("order")
    return [r.html for r in rows.collect()]


def model(pages: DataFrame, most: int = TRAIN_PAGES) -> dict[str, np.ndarray] | None:
    own = [b for b in map(blocks, sample(pages, most)) if roles(b).any()]
    if not own:
        return None
    rng = np.random.default_rng(5)
    texts = [b for page in own for b in page]
    shown = [(page, roles(page)) for page in own]
    shown += [variant(page, rng, texts) for _ in range(-(-VARIANTS // len(own))) for page in own]
    return trained([Page(p) for p, _ in shown], [y for _, y in shown])


def extracted(pages: DataFrame, keep: list[str], weights: dict[str, np.ndarray] | None) -> DataFrame:
    """The columns ``keep`` with main_text and n_chars."""
    source = pages.select(*dict.fromkeys([*keep, "html"]))
    at, kept = source.columns.index("html"), [source.columns.index(c) for c in keep]
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                own = [blocks(x.as_py()) for x in part.column(at)]
                marks = scores([Page(b) for b in own], shared.value) if shared.value is not None else [np.zeros(len(b)) for b in own]
                texts = ["\n".join(b.text for b, p in zip(page, mark) if p >= 0.5) for page, mark in zip(own, marks)]
                cells = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *cells], [*keep, "main_text", "n_chars"])

    fields = [source.schema[c] for c in keep] + [T.StructField("main_text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return source.mapInArrow(run, T.StructType(fields))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extracted(pages, ["page_id", "url"], model(pages))
    return out.select("page_id", "url", F.col("main_text").alias("text"), "n_chars")
