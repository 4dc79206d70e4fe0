"""Main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags; elements that are wholly beside the text (by
tag, role or an unmistakable name: menus, footers, forms, adverts, comments) leave the
sequence. The first pass rates each other block by its length, the density of stop words
and the density of links; a mark of the article and doubtful names are features that add to
the rating. What the rating leaves open, short blocks above all, gets the label of its
nearest decided neighbour in the second pass.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by for from had has have he her his if in into is it its not of on or she so that the
    their them there they this to was we were which who will with would you
    aber als am an auch auf aus bei bin bis da das dass dem den der des die doch ein eine einem einen einer es für hat
    ich im in ist ja mit nach nicht noch nur oder sein sich sie sind so über um und uns vom von vor war was wenn wie wir
    zu zum zur
    al ante como con cuando de del desde donde el ella en entre era es esa ese esta este fue ha hay la las le les lo los
    más me mi muy no nos o para pero por porque que se ser si sin sobre son su sus también un una y ya
    au aux avec ce ces cette comme dans de des du elle elles en est et eux il ils je la le les leur lui mais même ne nos
    nous on ou où par pas pour plus qu que qui sa sans se ses son sont sur tu un une vos vous
    """.split()
)
# Tags that end a block; whose content is no text; that stand beside the text.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center col colgroup dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li link main menu meta nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT_TAGS = frozenset("script style template iframe embed svg select textarea button datalist title head applet noframes".split())
BESIDE_TAGS = frozenset("nav footer aside form menu dialog header fieldset".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDED_BY_BLOCK = frozenset("p li dt dd option tr td th".split())
# Roles; names (words of class or id) of elements that are wholly beside the
# text, also as the first or last word of a longer name; words that only raise a doubt; tags
# of content, which no name takes away.
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
BESIDE_NAMES = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion promos cookie cookies consent gdpr popup popups modal sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs comment comments commentlist disqus respond footer footnav masthead login signin signup subscribe newsletter pagination pager topbar".split())
DOUBTFUL_NAMES = frozenset("notice notices alert alerts banner banners overlay side share sharing social related recommended reply replies discussion widget widgets toolbar skip disclaimer copyright search".split())
CONTENT_TAGS = frozenset("article main table tbody thead tfoot tr td th caption figure figcaption pre blockquote h1 h2 h3 h4 h5 h6 dl dt dd details summary body html".split())
# Words that make a longer name one of content (article-footer aside).
CONTENT_WORDS = frozenset("article content body main text post entry story".split())
MAIN_NAMES = re.compile(r"articlebody|mainentity", re.I)

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

#: Thresholds: most link share of running text; least characters of a block that isn't short
#: and of a long one; share of stop words from which text counts as running.
LINKS, SHORT, LONG, STOPS = 0.5, 40, 140, 0.2
#: Features: an article's mark inside and outside of it; a doubtful name of a heading or of
#: running text, and of other text.
INSIDE, OUTSIDE, DOUBT, DOUBT_SHORT = 2, -4, -2, -4


@dataclass
class Block:
    text: str
    link_chars: int
    beside: bool
    main: bool
    heading: bool
    doubt: bool = False

    @property
    def link_share(self) -> float:
        return self.link_chars / max(1, len(self.text))

    @property
    def running(self) -> bool:
        """Whether stop words are as frequent as in running text."""
        words = self.text.lower().split()
        return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) >= STOPS * len(words)


def _named(names: str) -> tuple[bool, bool]:
    """(wholly beside the text, doubtful) by the words of class and id."""
    beside = doubt = False
    for name in names.lower().split():
        words = re.split(r"[-_\d]+", name)
        if len(words) == 1 or not ({words[0], words[-1]} & CONTENT_WORDS):
            beside |= words[0] in BESIDE_NAMES or words[-1] in BESIDE_NAMES
            doubt |= len(words) <= 2 and (words[0] in DOUBTFUL_NAMES or words[-1] in DOUBTFUL_NAMES)
    return beside, doubt


def blocks(page: str) -> list[Block]:
    """The non-empty text blocks of a page in order; linear in its length."""
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, stands beside the text, is the article, doubtful
    opened: Counter[str] = Counter()
    out: list[Block] = []
    parts: list[str] = []
    links = depth = 0
    heading = False
    at = 0

    def where() -> tuple[bool, bool, bool]:
        return stack[-1][1:] if stack else (False, False, False)

    def close() -> None:
        nonlocal links, heading
        text = " ".join("".join(parts).split())
        if text:
            beside, main, doubt = where()
            out.append(Block(text, min(links, len(text)), beside, main, heading, doubt))
        parts.clear()
        links, heading = 0, False

    def text_to(end: int) -> None:
        nonlocal links
        if end > at:
            piece = entities.unescape(page[at:end])
            parts.append(piece)
            if depth:
                links += len("".join(piece.split()))

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    while m := TOKEN.search(page, at):
        text_to(m.start())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, rest = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in SILENT_TAGS and not closing:
            if tag in BLOCK_TAGS:
                close()
            if tag not in VOID_TAGS and not rest.endswith("/"):
                at = _after_silent(page, tag, at)
            continue
        if tag == "a":
            depth = max(0, depth - 1) if closing else depth + 1
        if tag == "br":
            parts.append(" ")
        if tag not in BLOCK_TAGS:
            continue
        close()
        depth = 0
        if tag in VOID_TAGS:
            continue
        if closing:
            if opened[tag]:
                while pop() != tag:
                    pass
            continue
        if stack and stack[-1][0] in ENDED_BY_BLOCK and (tag == stack[-1][0] or stack[-1][0] == "p"):
            pop()
        beside, main, doubt = where()
        named = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)} if "=" in rest else {}
        role = named.get("role", "").lower()
        by_name, doubtful = _named(f"{named.get('class', '')} {named.get('id', '')}")
        if tag in ("article", "main") or role in ("main", "article") or MAIN_NAMES.search(named.get("itemprop", "")):
            main = True
        elif tag in BESIDE_TAGS or role in BESIDE_ROLES or re.search(r"(?:^|\s)hidden(?:\s|=|$)", rest) or (by_name and tag not in CONTENT_TAGS):
            beside = True
        stack.append((tag, beside, main, doubt or (doubtful and tag not in CONTENT_TAGS)))
        opened[tag] += 1
        heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    text_to(len(page))
    close()
    return out


def _after_silent(page: str, tag: str, at: int) -> int:
    """Where the text goes on after an element whose content is no text."""
    end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
    if tag == "head":  # an unclosed one ends with the body's start
        start = re.compile(r"<body\b", re.I).search(page, at)
        if start and not (end and end.end() <= start.start()):
            return start.start()
    return end.end() if end else at if tag in ("head", "title") else len(page)


def rated(b: Block, has_main: bool) -> bool | None:
    """First pass: the label that length, stop words, links and marks give, or None.

    Running text of LONG characters rates 2, as other running text does inside a marked
    article; mostly links rate -2. From 2 on a block is text, down from -2 it is not."""
    rate = 0
    if b.link_share > LINKS:
        rate -= 2
    elif len(b.text) >= LONG:
        rate += 2 if b.running else -1 if b.link_share > 0.2 else 0
    elif len(b.text) >= SHORT and not b.running:
        rate -= 1
    if has_main:
        rate += INSIDE if b.main else OUTSIDE
    if b.doubt:
        rate += DOUBT if b.heading or (len(b.text) >= SHORT and b.running) else DOUBT_SHORT
    return True if rate >= 2 else False if rate <= -2 else None


def nearest(first: list[bool | None]) -> list[tuple[int | None, bool | None, int | None, bool | None]]:
    """For every block the distance and label of the last decided block before it and of the
    next one after it."""
    out: list[tuple] = [(None, None)] * len(first)
    at, label = None, None
    for k, own in enumerate(first):
        out[k] = (None if at is None else k - at, label)
        if own is not None:
            at, label = k, own
    at, label = None, None
    for k in range(len(first) - 1, -1, -1):
        out[k] += (None if at is None else at - k, label)
        if first[k] is not None:
            at, label = k, first[k]
    return out


def labels(found: list[Block]) -> list[bool]:
    """Whether each block is main text.

    Second pass: an open block has the label of its nearest decided neighbour by number of
    blocks. A heading belongs to what follows it, so the next one decides, and the last one
    only if none follows. At equal distance from unlike neighbours running text is text and
    the rest isn't. Where nothing is decided, blocks without links are text."""
    has_main = any(b.main and not b.beside for b in found)
    there = [k for k, b in enumerate(found) if not b.beside]
    first = [rated(found[k], has_main) for k in there]
    out = [False] * len(found)
    for k, own, (back, before, ahead, after) in zip(there, first, nearest(first), strict=True):
        b = found[k]
        if own is not None:
            out[k] = own
        elif back is None and ahead is None:
            out[k] = b.link_chars == 0
        elif b.heading and ahead is not None:
            out[k] = bool(after)
        elif back is None or (ahead is not None and ahead < back):
            out[k] = bool(after)
        elif ahead is None or back < ahead or before == after:
            out[k] = bool(before)
        else:
            out[k] = b.running
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, keep in zip(found, labels(found), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page. Null html is an empty page with empty text;
    a null URL stays null. Repeated rows give repeated results; other columns are ignored,
    whatever they are called. Very long pages are read whole, in linear time; an empty
    table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_batches(batches, 500):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    picked = pages.select(pages[id_col].cast("long").alias(id_col), pages[url_col].cast("string").alias(url_col), common.whole(pages[html_col]).alias("html"))
    return common.spread(picked).mapInArrow(run, f"{id_col} long, {url_col} string, text string, n_chars long")
