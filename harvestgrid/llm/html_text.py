"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass decides a block by where it stands (menus,
headers, footers, adverts, forms, comments are out; an article is in), by link density, and by length and stop-word
density. Stop words count only on pages in a language that has a list here. Short blocks that this leaves open take, in the second pass, the label of the nearest decided
neighbours.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their
    they this to was we were which who will with you
    als auch auf aus bei das dem den der des die ein eine einer es für hat ich ist mit nicht oder sich sie sind
    und von war wie wird zu zum
    au aux avec ce cette dans de du elle en est et il je la le les leur mais ne nous ou par pas plus pour qui que
    sa se ses son sur un une vous
    al como con del el ella era esta este fue ha las lo los más no para pero por sin su sus una y""".split()
)
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary
    table tbody td tfoot th thead title tr ul""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template iframe textarea xmp svg object canvas annotation annotation-xml".split())
OUT_TAGS = frozenset("nav header footer aside form menu dialog head title button select option label".split())
IN_TAGS = frozenset("article main".split())
# Of these, ``<x/>`` has no content.
FOREIGN_TAGS = frozenset("svg math".split())
# Names of a class, id or role that tell what is not the article.
OUT_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent
    cookie cookies dialog disqus footer form gdpr header masthead menu menubar modal nav navbar navigation
    newsletter notice notices pagination pager popup promo promotion related search share sharing sidebar
    social sponsor sponsored subscribe subscription toolbar topbar widget contentinfo complementary alert""".split()
)
# Words that may stand beside those in one name, as in comment-list; any others (has-sidebar, header-fixed) tell of a state.
PART_WORDS = frozenset(
    """area bar block body bottom box container content group inner item items left link links list main page panel
    right section site slot the thread top unit wrap wrapper""".split()
)
# Words that decide a name as its first or last word, whatever stands beside them.
DECIDING_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie newsletter promo
    sidebar sponsored""".split()
)
# Words that make a name tell of a state or a layout, not of a part.
STATE_WORDS = frozenset(
    """closed columns disabled enabled fixed free grid has hidden hide is layout no not off on open show sticky template
    toggle with without""".split()
)
# Languages with stop words here. A page that names no language has one of them if so many words of its text are stop words.
LISTED, LEAST_STOPS = frozenset("en de fr es".split()), 0.05
LINK_DENSITY, LONG, SHORT, HIGH_STOPS, LOW_STOPS = 0.5, 200, 70, 0.32, 0.2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_LANGUAGE = re.compile(r"""<html\b[^>]*?\slang\s*=\s*["']?\s*([a-zA-Z]+)""", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")
_SPLIT_NAME = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    out: bool
    inside: bool


def _named_out(attributes: str) -> bool:
    """Whether a whole name of a class, id or role tells what is not the article."""
    if "=" not in attributes:
        return False
    for attribute, *values in _ATTRIBUTE.findall(attributes):
        if attribute.lower() not in ("class", "id", "role"):
            continue
        for name in "".join(values).split():
            words = [w for w in _SPLIT_NAME.split(_CAMEL.sub("-", name).lower()) if w]
            if not words or not STATE_WORDS.isdisjoint(words):
                continue
            if words[0] in DECIDING_WORDS or words[-1] in DECIDING_WORDS:
                return True
            if not OUT_WORDS.isdisjoint(words) and OUT_WORDS.union(PART_WORDS).issuperset(words):
                return True
    return False


def _state(tag: str, attributes: str, out: str, inside: bool) -> str:
    """Why an element is out, within one that is ``out``: by a ``tag``, by a ``name`` (or a form around it), or not at all.

    An article that a named wrapper or a form holds is open again, unless another article holds it too.
    """
    if _named_out(attributes):
        return out if out == "tag" else "name"
    if tag in OUT_TAGS:
        return out or "name" if tag == "form" else "tag"
    return "" if tag in IN_TAGS and out == "name" and not inside else out


@dataclass
class Part:
    """A stretch of text: whether it stands in a link, in an element that is out, and in an article."""

    text: str
    link: bool
    out: bool
    inside: bool


@dataclass
class Open:
    """An open element: why it is out, whether it is in an article, and the place of the nearest block element from it on down."""

    tag: str
    out: str
    inside: bool
    block: int


class _Stack:
    """Open elements, with a count per tag, so that no question takes a walk through them."""

    def __init__(self) -> None:
        self.elements: list[Open] = []
        self.count: Counter = Counter()

    def state(self) -> tuple[str, bool]:
        return (self.elements[-1].out, self.elements[-1].inside) if self.elements else ("", False)

    def push(self, tag: str, out: str, inside: bool) -> None:
        block = len(self.elements) if tag in BLOCK_TAGS else self.elements[-1].block if self.elements else -1
        self.elements.append(Open(tag, out, inside, block))
        self.count[tag] += 1

    def pop(self) -> str:
        tag = self.elements.pop().tag
        self.count[tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        while self.pop() != tag:
            pass

    def end_implied(self, tag: str) -> None:
        """Close an open paragraph or list item that a new block ends, unless a container stands between."""
        at = self.elements[-1].block if self.elements else -1
        if at >= 0 and self.elements[at].tag == tag:
            while len(self.elements) > at:
                self.pop()


def _block(parts: list[Part]) -> Block | None:
    """The block that the parts make. What is out inside a block that is not goes without a trace; a block out as a whole stays so."""
    held = [p for p in parts if not p.out]
    out = not any(p.text and not p.text.isspace() for p in held)
    held = parts if out else held
    text = " ".join(html.unescape("".join(p.text for p in held)).split())
    if not text:
        return None
    linked = sum(len(" ".join(html.unescape(p.text).split())) for p in held if p.link)
    return Block(text, linked, out, any(p.inside for p in held))


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, white space made plain, character references decoded; empty ones are left out."""
    found: list[Block] = []
    parts: list[Part] = []
    stack = _Stack()
    breaks, at, size = 0, 0, len(page)

    def add(text: str) -> None:
        out, inside = stack.state()
        parts.append(Part(text, stack.count["a"] > 0, bool(out), inside))

    def end() -> None:
        nonlocal breaks
        breaks = 0
        block = _block(parts) if parts else None
        if block:
            found.append(block)
        parts.clear()

    while at < size:
        token = _TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        if token.start() > at:
            text = page[at : token.start()]
            add(text)
            if not text.isspace():
                breaks = 0
        at = token.end()
        tag = token[2]
        if tag is None:
            continue
        tag = tag.lower()
        if token[1]:
            if stack.count[tag]:
                if tag in BLOCK_TAGS:
                    end()
                stack.close(tag)
            continue
        if tag in FOREIGN_TAGS and token[3].endswith("/"):
            add(" ")
            continue
        if tag in RAW_TAGS:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else size
            add(" ")
            continue
        if tag == "br":
            add(" ")
            breaks += 1
            if breaks > 1:
                end()
            continue
        if tag in BLOCK_TAGS:
            end()
            if stack.count["p"] or tag == "li":
                stack.end_implied("li" if tag == "li" else "p")
        if tag not in VOID_TAGS:
            out, inside = stack.state()
            state = out if tag in ("html", "body") else _state(tag, token[3], out, inside)
            stack.push(tag, state, inside or tag in IN_TAGS)
    end()
    return found


def _stops(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(block: Block, listed: bool = True) -> str:
    """good, bad or short (still open). Without a list of the page's stop words only places, links and length count."""
    if block.out:
        return "bad"
    if block.inside:
        return "good"
    if block.linked > LINK_DENSITY * len(block.text):
        return "bad"
    # Scripts with more bytes a letter say as much in fewer letters.
    size = len(block.text) if listed else len(block.text.encode("utf-8", "replace"))
    if size < SHORT:
        return "bad" if block.linked else "short"
    if not listed:
        return "good" if size >= LONG else "short"
    stops = _stops(block.text)
    if stops >= HIGH_STOPS or (stops >= LOW_STOPS and len(block.text) >= LONG):
        return "good"
    return "short" if stops >= LOW_STOPS else "bad"


def has_stop_words(page: str, found: list[Block]) -> bool:
    """Whether the page is in a language with stop words here: the one it names, else by the share of stop words."""
    named = _LANGUAGE.search(page)
    if named:
        return named[1].lower() in LISTED
    text = " ".join(b.text for b in found if not b.out and b.linked <= LINK_DENSITY * len(b.text))
    return _stops(text) >= LEAST_STOPS


def second_pass(labels: list[str]) -> list[bool]:
    """Which blocks stay. An open block is good if a nearest decided neighbour is; without any, it goes."""
    before, last = [], None
    for k, label in enumerate(labels):
        last = (k, label) if label != "short" else last
        before.append(last)
    out, last = [False] * len(labels), None
    for k in range(len(labels) - 1, -1, -1):
        last = (k, labels[k]) if labels[k] != "short" else last
        near = [(abs(n[0] - k), n[1]) for n in (before[k], last) if n]
        least = min((d for d, _ in near), default=0)
        out[k] = any(label == "good" for d, label in near if d == least)
    return out


def main_text(page: str | None) -> str:
    """The page's article: blocks that stay, in page order, joined by a line feed."""
    if not page:
        return ""
    found = blocks(page)
    listed = all(b.inside or b.out for b in found) or has_stop_words(page, found)
    kept = second_pass([first_pass(b, listed) for b in found])
    return "\n".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Main text of every row: (page_id, url, text, n_chars).

    ``text`` is empty, never null, for null or empty pages and pages without an article; ``n_chars`` counts code
    points. Ids and urls are carried: null ones and repeated rows stay as they are. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"],
            )

    kinds = dict(rows.dtypes)
    texts = rows.mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
