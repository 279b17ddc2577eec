"""Main text of a web page by two passes over its blocks.

The first pass decides a block from its own link density, stop words and length, and from the elements around it. Short
blocks and blocks between the thresholds stay open. The second pass gives every open block the label of the
nearest decided blocks; where the two sides differ the nearer one counts, and the article's own edges count as decided text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame

LINK_DENSITY = 0.33
SHORT_CHARS = 70
LONG_CHARS = 200
STOP_LOW, STOP_HIGH = 0.20, 0.30

GOOD, BAD, OPEN = 1, 0, None

# frequent words of four languages
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he are this at from or have an they which you were but his her had we "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei sie nach wird einer um am sind "
    "le la les de des du et en un une est que dans qui par pour sur au pas plus ne se son ce il avec sont aux ou été elle "
    "el los las del y que en una por con para se no es al lo como más su o pero sus le ha este si esta entre".split()
)

RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "math", "audio", "video", "title", "xmp", "noframes")
FORM_PARTS = ("form", "button", "select", "textarea", "fieldset", "label", "option", "datalist", "dialog", "menu")
CHROME = ("nav", "footer", "aside", *FORM_PARTS)
MAIN = ("article", "main")
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup "
    "promo promotion related recommended search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
ARTICLE_HINTS = CHROME_HINTS | {"card", "cards", "teaser", "teasers", "reply", "replies", "preview"}
MAIN_HINTS = frozenset("article content entry main post story body text".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>", re.S
)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


@dataclass
class Block:
    text: str
    linked: int
    main: int  # number of the article around it, 0: none
    chrome: bool
    heading: bool
    label: int | None = field(default=OPEN)


def _kind(name: str, attributes: str, inside_main: bool) -> str:
    """What an element makes of its content: "chrome", "main" or ""."""
    if name in MAIN:
        found = "main"
    elif name in CHROME or (name == "header" and not inside_main):
        found = "chrome"
    else:
        found = ""
    if "=" in attributes or "hidden" in attributes:
        values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        words = {t.lower() for key in ("class", "id") for t in _TOKEN.findall(values.get(key, ""))}
        role = values.get("role", "").lower()
        if "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", "")):
            return "chrome"
        if role in CHROME_ROLES:
            return "chrome"
        if name == "article" and words & ARTICLE_HINTS:  # a card, a teaser or a comment, which are articles to HTML too
            return "chrome"
        if role == "main":
            return "main"
        if found != "main" and name not in ("html", "body") and words & CHROME_HINTS and not (words & MAIN_HINTS and not words & {"comment", "comments", "ad", "ads"}):
            return "chrome"
    return found


class _Open:
    """The open elements of a page, with what is asked of them all the time kept beside: how many are chrome, which article is the innermost, and how
    many there are of each name, so that a closing tag looks for its element only where there is one."""

    def __init__(self):
        self.stack: list[tuple[str, str, int]] = []  # element, kind, article number
        self.names: Counter[str] = Counter()
        self.chrome, self.mains, self.articles = 0, 0, [0]

    def push(self, name: str, kind: str) -> None:
        if kind == "main":
            self.mains += 1
            self.articles.append(self.mains)
        self.chrome += kind == "chrome"
        self.names[name] += 1
        self.stack.append((name, kind, self.mains if kind == "main" else 0))

    def pop(self) -> str:
        name, kind, _ = self.stack.pop()
        self.names[name] -= 1
        self.chrome -= kind == "chrome"
        if kind == "main":
            self.articles.pop()
        return name

    def top(self) -> str:
        return self.stack[-1][0] if self.stack else ""


def blocks_of(html: str) -> list[Block]:
    """Blocks of visible text in page order."""
    out: list[Block] = []
    held = _Open()
    parts: list[str] = []
    linked, in_link, heading, in_head = 0, 0, False, False
    at = 0

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, linked, held.articles[-1], held.chrome > 0, heading))
        parts.clear()
        linked = 0

    def take(text: str):
        nonlocal linked
        if text and not in_head:
            text = unescape(text)
            parts.append(text)
            if in_link:
                linked += len("".join(text.split()))

    while True:
        tag = _TAG.search(html, at)
        take(html[at : tag.start()] if tag else html[at:])
        if tag is None:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(tag[1] or tag[4]), tag[3] or tag[6] or ""
        if name in RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                end = _RAW_END[name].search(html, at)
                at = end.end() if end else len(html)
            continue
        if name == "head":
            in_head = not closing
            continue
        if name == "body":
            in_head = False
        if name == "br":
            parts.append(" ")
        if name == "a":
            in_link = 0 if closing else 1
        tracked = name not in VOID and (name in BLOCKS or name in CHROME or name in ("span", "header"))
        if name in BLOCKS or name in CHROME:
            flush()
            in_link = 0 if not closing and name in ("p", "li") else in_link
            heading = not closing and name[0] == "h" and name[1:].isdigit()
        if not tracked:
            continue
        if closing:
            if held.names[name]:
                kinds = 0
                for depth in range(len(held.stack) - 1, -1, -1):
                    kinds += bool(held.stack[depth][1])
                    if held.stack[depth][0] == name:
                        break
                if kinds:
                    flush()
                while held.pop() != name:
                    pass
        else:
            if name in BLOCKS and held.top() == "p":  # a block ends an open paragraph
                held.pop()
            if name in ("li", "dt", "dd", "td", "th", "tr", "option") and held.top() == name:
                held.pop()
            kind = _kind(name, attributes, held.articles[-1] > 0)
            if kind == "main" and held.chrome:  # an article inside a sidebar is part of the sidebar
                kind = ""
            if kind and name == "span":
                flush()
            if not attributes.rstrip().endswith("/"):
                held.push(name, kind)
    flush()
    return out


def _density(block: Block) -> float:
    words = re.findall(r"[^\W\d_]+", block.text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def _first_pass(block: Block, known: bool) -> int | None:
    """The label a block has by itself. known: whether the page is in a language with stop words here; if not, its length has to tell."""
    bare = len("".join(block.text.split()))
    if block.chrome or block.linked > LINK_DENSITY * bare:
        return BAD
    if block.main:
        return GOOD if len(block.text) >= SHORT_CHARS and not block.heading else OPEN
    if block.heading or len(block.text) < SHORT_CHARS:
        return BAD if "©" in block.text else OPEN
    density = _density(block) if known else STOP_HIGH
    if density >= STOP_HIGH:
        return GOOD if len(block.text) > LONG_CHARS else OPEN
    return OPEN if density >= STOP_LOW else BAD


def _own_language(blocks: list[Block]) -> bool:
    """Whether any of the longer blocks that could be text has the stop words of text; a page that has no such blocks counts as well."""
    long = [b for b in blocks if not b.chrome and not b.main and len(b.text) >= SHORT_CHARS and b.linked <= LINK_DENSITY * len(b.text)]
    return not long or max(map(_density, long)) >= STOP_LOW


def _named(blocks: list[Block]) -> bool:
    """Whether the page's articles are its text: decided text inside them, and no more of it outside."""
    inside = sum(len(b.text) for b in blocks if b.main and b.label == GOOD)
    outside = sum(len(b.text) for b in blocks if not b.main and b.label == GOOD)
    return inside > 0 and inside >= outside or not outside and any(b.main and not b.chrome for b in blocks)


def _nearest(blocks: list[Block], order: range) -> list[tuple[int, int]]:
    """For each block the label of the nearest decided block before it in the given order, and how far away it is.

    A block of an article looks no further than the article, whose edges are text, and past what is no text in it.
    """
    out = [(BAD, 0)] * len(blocks)
    last, text_of = None, {}  # (place, label) of the last decided block; place of the last text and of the beginning of each article
    article, begun = 0, 0
    for step, i in enumerate(order):
        block = blocks[i]
        own = 0 if block.chrome else block.main
        if own != article:
            article, begun = own, step
            text_of.pop(own, None)
        if block.main:
            out[i] = (GOOD, step - text_of.get(block.main, begun - 1)) if own else (GOOD, 1)
        else:
            out[i] = (last[1], step - last[0]) if last else (BAD, step + 1)
        if block.label is not OPEN:
            last = (step, block.label)
            if own and block.label == GOOD:
                text_of[own] = step
    return out


def classify(blocks: list[Block]) -> None:
    """Label every block. Where a page names its article, only blocks inside it can be text."""
    known = _own_language(blocks)
    for block in blocks:
        block.label = _first_pass(block, known)
    if _named(blocks):
        for block in blocks:
            if not block.main:
                block.label = BAD
    else:
        for block in blocks:
            block.main = 0
            block.label = _first_pass(block, known)
    before, after = _nearest(blocks, range(len(blocks))), _nearest(blocks, range(len(blocks) - 1, -1, -1))
    for block, (left, far_left), (right, far_right) in zip(blocks, before, after, strict=True):
        if block.label is not OPEN:
            continue
        if left == right:
            block.label = left
        elif block.heading:  # a heading goes with what follows
            block.label = right
        else:
            block.label = left if far_left <= far_right else right


def main_text(html: str | None) -> str:
    blocks = blocks_of(html or "")
    classify(blocks)
    return "\n\n".join(b.text for b in blocks if b.label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> page_id, url, text, n_chars; null or empty html and pages without text give ''.

    Every row gives one row, repeated rows too; further columns are not read. Pages are taken whole, and the time for one
    grows with its length.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(h) for h in frame["html"]]
            ids = pd.array([None if x is None else int(x) for x in frame["page_id"]], "Int64")
            yield pd.DataFrame({"page_id": ids, "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    # ids go to pandas as text, since whole numbers beside a null would lose digits
    kept = pages.selectExpr("CAST(CAST(page_id AS bigint) AS string) page_id", "CAST(url AS string) url", "CAST(html AS string) html")
    return kept.mapInPandas(run, "page_id long, url string, text string, n_chars long")
