"""Main text of web pages.

The standard library's parser streams a page's events; they fill *lines*, one for each block of text, with the number of
characters and of tags that each has. Text-to-tag ratios along the page are smoothed with a Gaussian and clustered by a
threshold (two means); lines above it are content. They vote, with their characters, for a content region: the ``article`` or
``main`` element that most of them lie in (all such elements that hold content), or else the smallest element around all of
them. All lines of the region are the text, so a short paragraph or a heading between long ones stays.

Never text, wherever they stand: scripts, styles, forms and what belongs to them, menus, headers, footers, side columns,
dialogs, hidden elements, and elements whose class, id or role names an advert, notice, menu or reader comments. A class or
id names one by a whole word of its list, alone or with known words around it (``site-header``, ``comments-area``), not by
a part of a layout's name (``has-sidebar``). Forms and names do not hide a page's content, for some wrap all of it: they are
read if they hold the ``main`` element; the ``article`` elements, where none stands elsewhere; or, without any such element,
more than half of the text. Cards and comments are no such articles, and adverts, menus and notices no such text.

Defined results: null html is empty; a page without text gives the empty string; markup left open ends with its parent;
repeated rows each keep a row; columns beside those named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import bound_batches

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKIP = frozenset("script style noscript template head title iframe object embed svg math canvas audio video form button select textarea input label fieldset nav menu header footer aside dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar sidenav skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split()
)
#: Words that may stand before or after a name in a class or id without a change of its meaning.
BEFORE = frozenset("site page main global top bottom left right primary secondary post entry article blog google user reader mobile desktop sub side in".split())
AFTER = frozenset("area bar block body bottom box button buttons col column container content form group icons inner item items label left link links list main outer panel primary right row secondary section slot text title top unit wrap wrapper".split())
#: Names of elements whose own articles are cards or comments, and with them those that are no content however long.
CARDS = frozenset("comment comments commentlist disqus related replies reply respond promo promoted promotion sponsor sponsored sponsors ad ads advert adverts advertisement advertising".split())
FIRM = CARDS | frozenset("breadcrumb breadcrumbs consent cookie cookies menu nav navbar navigation pager pagination".split())
#: What may stand in a head; anything else ends it, as its end tag may be left out.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
_PART = re.compile(r"[-_:]+")


def names(value: str) -> set[str]:
    """The words of NAMES that a class or id names."""
    out = set()
    for token in value.lower().split():
        parts = [p for p in (p.rstrip("0123456789") for p in _PART.split(token)) if p]
        at = [i for i, p in enumerate(parts) if p in NAMES]
        if at and all(p in BEFORE for p in parts[: at[0]]) and all(p in AFTER or p in NAMES for p in parts[at[0] :]):
            out.update(parts[i] for i in at)
    return out


class Lines(HTMLParser):
    """Turns events into lines: ``(chunks, tags, block)``; ``block`` numbers the innermost block element around the line.

    A chunk is ``(text, wrap, linked)``; ``wrap`` numbers the innermost element around it that is skipped unless ``unwrapped`` says
    otherwise. Elements are numbered as they open and know their parents, so memory follows the page and not its depth.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, bool]] = []
        self.count: dict[str, int] = {}
        self.skipped = self.number = self.tags = self.block = self.wrap = 0
        self.text: list[tuple[str, int, bool]] = []
        self.lines: list[tuple[list[tuple[str, int, bool]], int, int]] = []
        #: Numbers of article and main elements: whether main, and the wrap around it.
        self.regions: dict[int, tuple[bool, int]] = {}
        #: The block around each block, and the wrap around each wrap, in the order of their numbers.
        self.up: dict[int, int] = {}
        self.wrapped: dict[int, int] = {}
        self.named: dict[int, set[str]] = {}
        #: Blocks that hold the page rather than a part of it.
        self.roots: set[int] = {0}

    def end_line(self) -> None:
        if any(t and not t.isspace() for t, *_ in self.text):
            self.lines.append((self.text, self.tags, self.block))
        self.text = []
        self.tags = 0

    def pop_to(self, tag: str) -> None:
        """Close elements up to and with the innermost ``tag``, which must be open."""
        while True:
            name, number, skip, wrap = self.open.pop()
            self.count[name] -= 1
            self.skipped -= skip
            if wrap:
                self.wrap = self.wrapped[number]
            if name in BLOCK:
                self.block = self.up[number]
            if name == tag:
                return

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections are comments in a page, whatever they are called."""
        return self.parse_bogus_comment(i)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append((" ", 0, False))
            return
        if tag not in HEAD and self.count.get("head") and not self.count.get("template") and not self.count.get("noscript"):
            self.pop_to("head")
        if tag in BLOCK:
            self.end_line()
            if self.count.get("p"):  # a paragraph ends where any block starts
                self.pop_to("p")
            self._imply(tag)
        if tag in VOID:
            return
        a = {k: v or "" for k, v in attrs}
        named = set() if tag in ("html", "body", "article", "main") else names(f"{a.get('class', '')} {a.get('id', '')}")
        wrap = tag == "form" or bool(named)
        skip = self._skips(tag) or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true"
        self.number += 1
        self.open.append((tag, self.number, skip, wrap))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.skipped += skip
        if wrap:
            self.wrapped[self.number] = self.wrap
            self.wrap = self.number
            self.named[self.number] = named
        if tag in BLOCK:
            self.up[self.number] = self.block
            self.block = self.number
            if tag == "body":
                self.roots.add(self.number)
        if tag in ("article", "main") or a.get("role", "").lower() in ("main", "article"):
            self.regions[self.number] = (tag == "main" or a.get("role", "").lower() == "main", self.wrap)

    def _skips(self, tag: str) -> bool:
        """Elements that never hold content; the header of an article or of the main part is its own."""
        if tag == "header" and (self.count.get("article") or self.count.get("main")):
            return False
        return tag in SKIP and tag != "form"

    def _imply(self, tag: str) -> None:
        """List items, table cells and terms end where the next one starts."""
        ends, within = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr"))}.get(tag, ((), ()))
        if not any(self.count.get(t) for t in ends):
            return
        for name, *_ in reversed(self.open):
            if name in within:
                return
            if name in ends:
                self.pop_to(name)
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        if self.count.get(tag):
            self.pop_to(tag)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self.pop_to("head")
        if not self.skipped:
            self.text.append((data, self.wrap, bool(self.count.get("a"))))

    def region_of(self) -> dict[int, int]:
        """The innermost article or main element that each block is or lies in; 0 for none."""
        out = {0: 0}
        for block, outer in self.up.items():
            out[block] = block if block in self.regions else out[outer]
        return out

    def unwrapped(self) -> set[int]:
        """Forms and named elements that are read, since they wrap the page's content."""
        region, own, by = self.region_of(), dict.fromkeys(self.regions, 0), dict.fromkeys((0, *self.wrapped), 0)
        for chunks, _, block in self.lines:
            inner = region[block]
            for text, wrap, _ in chunks:
                n = len("".join(text.split()))
                by[wrap] += n
                if inner and self.regions[inner][1] == wrap:
                    own[inner] += n
        for r in sorted(own, reverse=True):  # inner ones first; a wrap between two keeps them apart
            outer = region[self.up[r]] if r in self.up else 0
            if outer and self.regions[outer][1] == self.regions[r][1]:
                own[outer] += own[r]
        read: set[int] = set()
        for r, (is_main, wrap) in self.regions.items():
            if is_main and own[r]:
                while wrap and wrap not in read:
                    read.add(wrap)
                    wrap = self.wrapped[wrap]
        clear = self._clear(read)
        if any(n and clear[self.regions[r][1]] for r, n in own.items()):
            return read
        cards, firm = ({0: False} for _ in range(2))
        for w, outer in self.wrapped.items():
            cards[w], firm[w] = cards[outer] or bool(self.named[w] & CARDS), firm[outer] or bool(self.named[w] & FIRM)
        inside = [r for r, n in own.items() if n and not cards[self.regions[r][1]]]
        if inside:
            wrap = self.regions[max(inside, key=own.get)][1]
            while wrap:
                read.add(wrap)
                wrap = self.wrapped[wrap]
            return read
        # else those that hold more than half of the text, but for what is no content however long
        half, held = sum(by.values()) / 2, {w: 0 if firm[w] else n for w, n in by.items()}
        for w in reversed(self.wrapped):
            held[self.wrapped[w]] += held[w]
            if held[w] > half:
                read.add(w)
        return read

    def _clear(self, read: set[int]) -> dict[int, bool]:
        """Whether all wraps from one outwards are read."""
        out = {0: True}
        for w, outer in self.wrapped.items():
            out[w] = out[outer] and w in read
        return out

    def kept(self) -> list[tuple[str, int, int, int]]:
        """Lines with the text that is not skipped, their tags, the letters of it that are links, and their block."""
        clear, made = self._clear(self.unwrapped() if self.named else set()), []
        for chunks, tags, block in self.lines:
            some = [(t, linked) for t, wrap, linked in chunks if clear[wrap]]
            text = " ".join("".join(t for t, _ in some).split())
            if text:
                made.append((text, tags, sum(len(t.strip()) for t, linked in some if linked), block))
        return made


def content(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Which lines are content: smoothed ratios above the threshold between their two clusters."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    smooth = np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight
    low, high = smooth.min(), smooth.max()
    for _ in range(30):
        cut = (low + high) / 2
        above = smooth > cut
        if above.all() or not above.any():
            break
        new = smooth[~above].mean(), smooth[above].mean()
        if new == (low, high):
            break
        low, high = new
    return smooth >= (low + high) / 2


def main_text(html: str | None) -> str:
    """The main text of a page, blocks joined by an empty line."""
    p = Lines()
    p.feed(html or "")
    p.close()
    p.end_line()
    lines = p.kept()
    if not lines:
        return ""
    size = np.array([len(t) for t, *_ in lines])
    good = content(size / np.maximum(1, [n for _, n, _, _ in lines]))
    region = p.region_of()
    inside = np.array([region[block] > 0 for *_, block in lines])
    chosen = inside if 2 * size[good & inside].sum() > size[good].sum() else _around(p, lines, good)
    return "\n\n".join(line[0] for line, c in zip(lines, chosen) if c)


def _around(p: Lines, lines: list[tuple[str, int, int, int]], good: np.ndarray) -> np.ndarray:
    """Lines of the element that holds all good ones, and of those around it while what they add is text rather than links."""
    blocks = np.array([block for *_, block in lines])
    size, linked = np.array([len(t) for t, *_ in lines]), np.array([n for _, _, n, _ in lines])
    held = dict.fromkeys((0, *p.up), 0)
    for block, g in zip(blocks.tolist(), good.tolist()):
        held[block] += g
    for block in reversed(p.up):
        held[p.up[block]] += held[block]
    inner = max((block for block, n in held.items() if n == good.sum()), default=0)
    if good.sum() == 1 and inner in p.up and p.up[inner]:  # a single line names its parent, or its own siblings would be lost
        inner = p.up[inner]

    # how far out each line comes in: 0 within the inner element, k within the k-th element around it
    level, out = {inner: 0}, inner
    while out not in p.roots and p.up[out] not in p.roots:
        out = p.up[out]
        level[out] = len(level)
    joins = {0: level.get(0, -1)}
    for block, above in p.up.items():
        joins[block] = level.get(block, joins[above])
    at = np.array([joins[block] for block in blocks.tolist()])
    size_at, linked_at = (np.bincount(at[at >= 0], n[at >= 0], len(level)) for n in (size, linked))
    stop = np.flatnonzero(3 * linked_at[1:] > size_at[1:])
    return (at >= 0) & (at < (stop[0] + 1 if len(stop) else len(level)))


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages`` (``page_id``, ``url``, ``html``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h) for h in b.pop("html")]
            yield b.assign(text=text, n_chars=[len(t) for t in text]).astype({"page_id": "Int64", "n_chars": "int64"})

    bound_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint")
