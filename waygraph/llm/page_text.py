"""Main text of web pages by tag-path ratios.

A page is cut into blocks: stretches of text between the tags that begin or end a
block.  Each has its path of block tags from the root.  For each path the mean length of its
blocks' text and the mean count of their punctuation marks are taken; every block then
has its path's two figures, which a Gaussian window over the blocks in page order smooths.  A path's score
is the product of both, lowered by its share of linked text, and fused with the bare product of all that lies right below the
path above it, so that a short heading among long paragraphs stands with them, and a stray line beside them doesn't. Beside an
article, or the page's main part, it falls by the share of the text that lies in there.  Paths whose fused score reaches a
share of the page's mean give the text.

Elements that aren't running text by their kind (scripts, menus, forms ...), by their role, or by a word of their
class or id are set aside before any figure is taken, with all that they hold.

Defined results: a null or empty page, and one without any block left, gives an empty text; tags that never close end with
the page, end tags that close nothing count for nothing, a tag whose quotes don't close ends at its first `>`, and raw text (script, style) that never ends takes
the rest of the page; white space is what Python's str.split parts at, the no-break space with it; `<br>` is white space; every row
of a repeated or null id gives a row; other columns aren't read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from waygraph.llm.common import map_arrow, table

#: Tags inside a line of text: they neither cut blocks nor count in paths.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Tags without content.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Tags whose content is characters up to their own end tag.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Tags that hold no running text.
ASIDE = frozenset("head script style title noscript template nav footer aside form button select option optgroup datalist fieldset legend textarea xmp iframe noembed noframes dialog menu svg math canvas object applet audio video map".split())
#: Roles likewise, and words of a class or id.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promotions banner banners nav navbar navigation menu menus breadcrumb breadcrumbs footer sidebar sidebars widget widgets "
    "cookie cookies consent gdpr notice notices disclaimer popup modal overlay newsletter subscribe subscription signup login search searchbox share sharing social related recommended recommendations comment comments commentlist "
    "reply replies respond disqus discussion toolbar pagination pager skip hidden copyright".split()
)
#: Those that are set aside outside an article only, where they may hold its title.
HEADS = frozenset("header masthead topbar".split())
MAIN = frozenset("article main".split())
#: The words that set an article itself aside.
NOT_MAIN = frozenset("comment reply ad ads advert sponsored promo related".split())
#: A start tag closes open ones of these kinds, up to the kinds after the bar.
CLOSES = {"li": "li|ul ol menu", "dt": "dt dd|dl", "dd": "dt dd|dl", "tr": "tr td th|table", "td": "td th|tr table", "th": "td th|tr table", "thead": "tr td th tbody|table", "tbody": "tr td th thead tbody|table", "tfoot": "tr td th tbody|table", "body": "head|html"}
CLOSES = {tag: tuple(frozenset(side.split()) for side in rule.split("|")) for tag, rule in CLOSES.items()}
#: What ends an open paragraph.
BREAKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split())
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(frozen=True)
class Ratios:
    """share: of the page's mean score that a path must reach. window: blocks on each side that smooth, and its deviation."""

    share: float = 0.25
    window: int = 2
    deviation: float = 1.0


@dataclass
class Block:
    path: int
    pieces: list[str] = field(default_factory=list)
    linked: int = 0


class Page:
    """One pass over a page: its blocks, and for each path its name and the path above."""

    def __init__(self, source: str) -> None:
        self.names, self.above, self.known = [""], [-1], {}
        self.blocks: list[Block] = []
        self.inside: list[bool] = [False]  # an article, of each path
        # tag, path, set aside, in an article
        self.open: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        self.count: dict[str, int] = {}
        self.block: Block | None = None
        self.links = 0
        self._read(source)
        self._end_block()

    def _read(self, s: str) -> None:
        at, tags = 0, _TAG
        while at < len(s):
            start = s.find("<", at)
            if start < 0:
                self._text(s[at:])
                return
            if start > at:
                self._text(s[at:start])
            follows = s[start + 1 : start + 2]
            if s.startswith("<!--", start):
                end = s.find("-->", start + 4)
                at = len(s) if end < 0 else end + 3
            elif follows in ("!", "?"):
                end = s.find(">", start)
                at = len(s) if end < 0 else end + 1
            elif follows.isascii() and follows.isalpha() or follows == "/" and s[start + 2 : start + 3].isalpha():
                got = tags.match(s, start)
                if got is None and tags is _TAG:
                    # quotes that don't close: no tag of this page is read by its quotes from here
                    tags = _PLAIN
                    got = tags.match(s, start)
                if got is None:
                    return
                at = self._tag(got, s)
            else:
                self._text("<")
                at = start + 1

    def _text(self, raw: str) -> None:
        if self.open[-1][2]:
            return
        if self.block is None:
            if raw.isspace():
                return
            self.block = Block(self.open[-1][1])
        piece = html.unescape(raw)
        self.block.pieces.append(piece)
        if self.links:
            self.block.linked += len(piece)

    def _tag(self, got: re.Match, s: str) -> int:
        ends, tag, rest = got[1] == "/", got[2].lower(), got[3]
        if tag in INLINE and not (not ends and self._aside(tag, rest)):
            if tag == "br" and self.block is not None:
                self.block.pieces.append(" ")
            if tag == "a":
                self.links = 0 if ends else 1
            if not (ends and self.count.get(tag)):
                return got.end()
        if ends:
            if self.count.get(tag):
                self._close(tag)
            elif tag == "p":
                self._end_block()
            return got.end()
        self._end_block()
        if tag in BREAKS and self.count.get("p"):
            self._close_within(frozenset("p"), frozenset("button table td th caption object applet".split()))
        if tag in CLOSES:
            while self._close_within(*CLOSES[tag]):
                pass
        if tag in VOID:
            return got.end()
        _, path, aside, main = self.open[-1]
        aside = aside or self._aside(tag, rest)
        main = main or tag in MAIN
        name = tag if tag in ("html", "body") else tag + "".join(f".{c}" for c in self._classes(rest)[:1])
        self.open.append((tag, self._path(path, name, main), aside, main))
        self.count[tag] = self.count.get(tag, 0) + 1
        if tag in RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.IGNORECASE).search(s, got.end())
            self._text(s[got.end() : end.start() if end else len(s)])
            return end.start() if end else len(s)
        return got.end()

    def _attributes(self, rest: str) -> dict[str, str]:
        return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)} if rest and not rest.isspace() else {}

    def _classes(self, rest: str) -> list[str]:
        return self._attributes(rest).get("class", "").split()

    def _aside(self, tag: str, rest: str) -> bool:
        main = self.open[-1][3]
        if tag in ASIDE or tag in HEADS and not main:
            return True
        own = self._attributes(rest)
        if not own or tag in ("html", "body"):
            return False
        if tag in MAIN:
            return any(w.lower() in NOT_MAIN for w in _NAME.findall(own.get("class", "")))
        if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", ""), re.IGNORECASE) or own.get("role", "").lower() in ROLES:
            return True
        for name in f"{own.get('class', '')} {own.get('id', '')}".split():
            words = [w.lower() for w in _NAME.findall(name)]
            # has-sidebar, with-ads: a wrapper that holds other things too
            if words and words[0] in ("has", "with", "no", "without", "is"):
                continue
            if any(w in WORDS or w in HEADS and not main for w in words):
                return True
        return False

    def _path(self, above: int, name: str, main: bool) -> int:
        if (above, name) not in self.known:
            self.known[above, name] = len(self.names)
            self.names.append(name)
            self.above.append(above)
            self.inside.append(main)
        return self.known[above, name]

    def _pop(self) -> str:
        tag = self.open.pop()[0]
        self.count[tag] -= 1
        return tag

    def _close(self, tag: str) -> None:
        self._end_block()
        while self._pop() != tag:
            pass

    def _close_within(self, kinds: frozenset[str], until: frozenset[str]) -> bool:
        """Close the nearest open element of the kinds, unless one of until lies nearer."""
        if not any(self.count.get(k) for k in kinds):
            return False
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at][0]
            if tag in kinds:
                while len(self.open) > at:
                    self._pop()
                return True
            if tag in until:
                return False
        return False

    def _end_block(self) -> None:
        if self.block is not None:
            self.block.pieces = [" ".join("".join(self.block.pieces).split())]
            if self.block.pieces[0]:
                self.blocks.append(self.block)
            self.block = None
        self.links = 0

    def name(self, path: int) -> str:
        names = []
        while path > 0:
            names.append(self.names[path])
            path = self.above[path]
        return "/".join(reversed(names))


def smooth(values: np.ndarray, r: Ratios) -> np.ndarray:
    """Means of values in page order under a Gaussian window, which the page's ends cut short."""
    w = np.exp(-(np.arange(-r.window, r.window + 1) ** 2) / (2 * r.deviation**2))
    full = np.convolve(values, w)[r.window : r.window + len(values)]
    return full / np.convolve(np.ones(len(values)), w)[r.window : r.window + len(values)]


def path_scores(page: Page, r: Ratios) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Figures of each path that has blocks: blocks, chars, marks, linked share, score; and which of the page's blocks are content."""
    where = np.array([b.path for b in page.blocks])
    chars = np.array([len(b.pieces[0]) for b in page.blocks], float)
    marks = np.array([len(PUNCTUATION.findall(b.pieces[0])) for b in page.blocks], float)
    linked = np.array([min(b.linked, len(b.pieces[0])) for b in page.blocks], float)
    paths, own, n = np.unique(where, return_inverse=True, return_counts=True)
    mean = lambda v: np.bincount(own, v) / n
    long, points = mean(chars), mean(marks)
    link = np.bincount(own, linked) / np.bincount(own, chars)
    score = mean(smooth(long[own], r) * (1 + smooth(points[own], r)) * (1 - link[own]))
    # the path above: the mean of all blocks on paths that end right below it, without their neighbours
    bare = long * (1 + points) * (1 - link)
    _, group = np.unique([page.above[p] for p in paths], return_inverse=True)
    above = (np.bincount(group, bare * n) / np.bincount(group, n))[group]
    fused = np.sqrt(score * above)
    # the more of the text lies in an article, the less a path beside it counts
    main = np.array([page.inside[p] for p in paths])
    fused = np.where(main, fused, fused * (1 - (long * n)[main].sum() / (long * n).sum()))
    kept = fused >= r.share * (fused * n).sum() / n.sum()
    return {"path": paths, "blocks": n, "chars": long, "marks": points, "linked": link, "score": fused, "kept": kept}, kept[own]


def content(source: str | None, r: Ratios) -> tuple[str, int]:
    """The page's text, and how many of its blocks were left out by their ratios."""
    page = Page(source or "")
    if not page.blocks:
        return "", 0
    _, keep = path_scores(page, r)
    return "\n".join(b.pieces[0] for b, k in zip(page.blocks, keep, strict=True) if k), int((~keep).sum())


def extract(pages: DataFrame, r: Ratios | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_left_out of every page."""
    r = r or Ratios()

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        got = [content(x, r) for x in cols["html"]]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": [t for t, _ in got], "n_chars": [len(t) for t, _ in got], "n_left_out": [n for _, n in got]}

    return map_arrow(pages.select("page_id", "url", "html"), kernel, "page_id bigint, url string, text string, n_chars bigint, n_left_out bigint")


def tag_paths(pages: DataFrame, r: Ratios | None = None) -> DataFrame:
    """page_id, path, blocks, chars, marks, linked, score, kept: the figures by which extract decides, of each path of each page."""
    r = r or Ratios()

    def rows(page_id: int | None, source: str | None) -> Iterator[tuple]:
        page = Page(source or "")
        if page.blocks:
            got, _ = path_scores(page, r)
            for i, p in enumerate(got["path"]):
                yield (page_id, page.name(int(p)), *(got[c][i].item() for c in ("blocks", "chars", "marks", "linked", "score", "kept")))

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        all_rows = [row for i, x in zip(cols["page_id"], cols["html"], strict=True) for row in rows(i, x)]
        return {n: [row[j] for row in all_rows] for j, n in enumerate(("page_id", "path", "blocks", "chars", "marks", "linked", "score", "kept"))}

    return map_arrow(pages.select("page_id", "html"), kernel, "page_id bigint, path string, blocks bigint, chars double, marks double, linked double, score double, kept boolean")


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
