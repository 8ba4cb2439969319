"""HTML extraction (operator 5).

Method: a page becomes a list of text blocks, each with its root-to-leaf tag path.  Text length and punctuation
are added up per path and divided by the path's blocks; both ratios are smoothed over the blocks in page order,
fused by their product, and paths whose fused ratio passes a threshold relative to the page's own spread are
content.  All content blocks give text, wherever they stand.  The smallest element that holds all of them is the
home; blocks between them, its headings before them, and its blocks after them that are not mostly links belong to
the text too.  Where the home, or an element in it that holds nearly all of the content, is an article by its tag
or class, all blocks of that element do, but for links that stand alone outside of paragraphs, lists and tables.

Menus, headers, footers, sidebars, notices, adverts, forms and comment sections never give text.  Tags and roles tell
them; a header inside an article or main element is part of it.  A class or an id only makes an element suspect, and
only if all of its parts are words of boilerplate or of layout (site-footer, nav-menu, but not search-results-explained);
headings, paragraphs, list items, cells and inline elements are never suspect, and inside an article or main element ids
are not heeded, but for those of reader comments, since ids are often made from headings.  Suspects go if their own
ratios are poor or they stand outside of what is content: inside an article or main element one goes unless its blocks
have as good a fused ratio as the article's other blocks, or it holds an h1 and nothing else; elsewhere one stays if it
is a page's wrapper, that is, where next to nothing of the page's text stands outside of all suspects and it holds most
of what stands in them.  Words that say what an element has or lacks (has-sidebar, no-comments) are not heeded.

Character references are decoded within each stretch of text between tags, white space inside a block becomes one space, blocks are joined by one space.
Null, empty and text-free pages give an empty text.  Each row is handled alone: repeated rows, null urls or keys
and extra columns have no influence, and an empty table gives an empty result.  Malformed pages are read in time
proportional to their length: a tag that never closes is text, quotes are no longer heeded in a page where they
were misread for several times its length, and elements more than DEPTH deep count as their ancestor, but for
boilerplate by tag or role, which is left out however deep it stands.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MARKUP = re.compile(r"<(?:!--|[!?/a-zA-Z])")
NAME = re.compile(r"/?[a-zA-Z][^\s/<>]*+")
#: The rest of a tag: quoted strings may hold any character; without quotes it ends at the first bracket.
QUOTED = re.compile(r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+")
PLAIN = re.compile(r"[^<>]*+")
MISREAD = 4  # times a page's length that may be read in vain
DEPTH = 512
ATTRIBUTE = re.compile(r"([a-zA-Z-]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
RAW = {"script", "style", "textarea", "title", "template", "noscript", "svg", "iframe", "object", "math", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr acronym nobr".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
SCOPE = {"table", "ul", "ol", "dl", "body", "article", "section", "div", "main", "td", "th", "select"}
BOILER_TAGS = set("nav header footer aside form button select menu dialog noscript figcaption head datalist fieldset".split()) - {"figcaption", "fieldset"}
BOILER_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner nav navbar navigation menu menus sidebar sidebars aside footer footers masthead "
    "topbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay share sharing social related recommended "
    "recommendations breadcrumb breadcrumbs pagination pager newsletter subscribe subscription signup login search form widget widgets toolbar copyright disclaimer skip hidden header".split()
)
COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "respond"}
#: Words of layout that may stand beside a word of boilerplate in one name.
LAYOUT_WORDS = set("site page main top bottom left right upper lower list area box bar wrap wrapper container content inner outer section block item items primary secondary global link links post user reader row col column group panel module header footer slot unit thread form".split())
#: Classes that begin so say what an element has or lacks.
STATE_WORDS = {"no", "has", "with", "without", "is", "not"}
WRAPPER_CHARS = 140  # of unlinked text that a wrapper holds at least
OUTSIDE = 0.05  # of a page's unlinked text: with less outside, boilerplate by class words holds the page
ARTICLE_WORDS = set("content article post entry story main text body".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
SHARE = 0.8  # of the content text that an element holds at least to be looked at as the article; no content is left out by it
LEAVES = {"p", "h1", "h2", "h3", "li", "td", "th", "tr", "pre"}
#: Elements that are never suspect.
TEXT_TAGS = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead table pre blockquote figure html body main article".split())


class Block:
    __slots__ = ("chain", "link", "parts", "path", "text")

    def __init__(self, chain: tuple[int, ...], path: str):
        self.chain, self.path, self.parts, self.link, self.text = chain, path, [], 0, ""


class Element(NamedTuple):
    tag: str
    words: set[str]
    #: 0 for content, 1 if a name or a form makes it suspect, 2 if the tag, role or hiding tells, or the name of reader comments.
    boiler: int
    #: Whether it is an article or main element, or stands in one.
    inside: bool = False


class Names(NamedTuple):
    """What the attributes of a tag say: words of class and id, boilerplate and reader comments by class and by id, hiding and role."""

    words: set[str]
    by_class: bool
    by_id: bool
    talk: bool
    bad: bool


def _names(attributes: str) -> Names:
    words: set[str] = set()
    bad, talk, told = False, False, {"class": False, "id": False}
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name in ("class", "id"):
            for token in value.split():
                parts = [x for x in re.split(r"[_-]+|\d+$", token) if x]
                if parts and parts[0] not in STATE_WORDS:
                    words.update(parts)
                    whole = set(parts) <= BOILER_WORDS | COMMENT_WORDS | LAYOUT_WORDS
                    talk |= whole and not COMMENT_WORDS.isdisjoint(parts)
                    told[name] |= whole and not BOILER_WORDS.isdisjoint(parts)
        elif name == "role":
            bad |= value in BOILER_ROLES
        elif name == "aria-hidden":
            bad |= value == "true"
        elif name == "hidden":
            bad = True
        elif name == "style":
            bad |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
    return Names(words, told["class"], told["id"], talk, bad)


NO_NAMES = Names(set(), False, False, False, False)


class Reader:
    """Text blocks in page order, and the elements they stand in."""

    def __init__(self, page: str):
        self.page, self.vain = page, 0
        self.stack: list[tuple[str, int, str]] = [("#", 0, "")]  # tag, element, path
        self.open: dict[str, int] = defaultdict(int)  # elements of a tag on the stack
        self.deep: list[tuple[str, bool]] = []  # open elements beyond DEPTH, and whether they are boilerplate
        self.deep_open: dict[str, int] = defaultdict(int)
        self.boiled = 0  # open boilerplate beyond DEPTH
        self.elements = [Element("#", set(), 0)]
        self.blocks: list[Block] = []
        self.block: Block | None = None
        self.links = 0
        self._read()
        for b in self.blocks:
            b.text = " ".join("".join(b.parts).split())
        self.blocks = [b for b in self.blocks if b.text]

    def _put(self, text: str) -> None:
        if self.boiled:
            return
        text = html_lib.unescape(text)
        if self.block is None:
            if not text or text.isspace():
                return
            self.block = Block(tuple(s[1] for s in self.stack), self.stack[-1][2])
            self.blocks.append(self.block)
        self.block.parts.append(text)
        if self.links:
            self.block.link += len(text)

    def _pop_to(self, depth: int) -> None:
        for tag, _, _ in self.stack[depth:]:
            self.open[tag] -= 1
        del self.stack[depth:]
        self.block = None

    def _tag_end(self, at: int) -> int:
        """Where the > of a tag stands whose name ends at at; -1 if it never closes."""
        page = self.page
        if self.vain <= MISREAD * len(page):
            end = QUOTED.match(page, at).end()
            if page.startswith(">", end):
                return end
            self.vain += end - at
        end = PLAIN.match(page, at).end()
        return end if page.startswith(">", end) else -1

    def _read(self) -> None:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            m = MARKUP.search(page, at)
            if m is None:
                self._put(page[at:])
                break
            start = m.start()
            if start > at:
                self._put(page[at:start])
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else n
                continue
            name = NAME.match(page, start + 1)
            if name is None:  # a declaration, or a bracket that begins no tag
                end = PLAIN.match(page, start + 1).end()
                if page[start + 1] in "!?/" and page.startswith(">", end):
                    at = end + 1
                else:
                    self._put("<")
                    at = start + 1
                continue
            end = self._tag_end(name.end())
            if end < 0:
                self._put("<")
                at = start + 1
                continue
            at = self._tag(name[0].lower(), page[name.end() : end], end + 1)

    def _tag(self, name: str, attributes: str, at: int) -> int:
        """Handles a tag and says where to read on."""
        closing, empty = name.startswith("/"), attributes.endswith("/")
        name = name.removeprefix("/")
        if name in RAW and not closing and not empty:
            close = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(self.page, at)
            return close.end() if close else len(self.page)
        if name == "br":
            self._put(" ")
        elif name in INLINE:
            if name == "a":
                self.links = max(0, self.links + (-1 if closing else 1))
            elif not closing and attributes and _hides(attributes):
                return self._skip(at, name)
        elif closing:
            self._close(name)
        else:
            self._open(name, attributes, empty)
        return at

    def _close(self, name: str) -> None:
        self.block = None
        if self.deep:
            if self.deep_open[name] > 0:
                while True:
                    tag, bad = self.deep.pop()
                    self.deep_open[tag] -= 1
                    self.boiled -= bad
                    if tag == name:
                        return
            if not self.open[name]:
                return
            self.deep.clear()
            self.deep_open.clear()
            self.boiled = 0
        if self.open[name] > 0:
            self._pop_to(next(d for d in range(len(self.stack) - 1, 0, -1) if self.stack[d][0] == name))

    def _open(self, name: str, attributes: str, empty: bool) -> None:
        self.block = None
        if name in VOID:
            return
        ends = SELF_CLOSING.get(name, set()) | ({"p"} if name in CLOSES_P else set())
        if not self.deep and any(self.open[e] > 0 for e in ends):
            for depth in range(len(self.stack) - 1, 0, -1):
                if self.stack[depth][0] in ends:
                    self._pop_to(depth)
                    break
                if self.stack[depth][0] in SCOPE:
                    break
        self.links = 0
        if empty:
            return
        names = _names(attributes) if attributes else NO_NAMES
        inside = self.elements[self.stack[-1][1]].inside
        boiler = 0
        if name in BOILER_TAGS:
            boiler = 1 if name == "form" else 0 if name == "header" and inside else 2
        elif names.bad and name not in ("html", "body", "main", "article"):
            boiler = 2
        if not boiler and name not in TEXT_TAGS:
            boiler = 2 if names.talk else 1 if names.by_class or (names.by_id and not inside) else 0
        if self.deep or len(self.stack) > DEPTH:
            self.deep.append((name, boiler == 2))
            self.deep_open[name] += 1
            self.boiled += boiler == 2
            return
        self.stack.append((name, len(self.elements), f"{self.stack[-1][2]}/{name}"))
        self.open[name] += 1
        self.elements.append(Element(name, names.words, boiler, inside or name in ("article", "main")))

    def _skip(self, at: int, name: str) -> int:
        """Past the end tag of a hidden inline element; where it has none, or too much was read in vain, nothing is skipped."""
        depth = 1
        if self.vain <= MISREAD * len(self.page):
            for m in re.compile(rf"<(/?){re.escape(name)}\b[^<>]*+>", re.I).finditer(self.page, at):
                depth += -1 if m[1] else 1
                if not depth:
                    return m.end()
            self.vain += len(self.page) - at
        return at


def _hides(attributes: str) -> bool:
    return _names(attributes).bad


def _ratio(blocks: list[Block]) -> float:
    """Fused text, punctuation and link ratio of some blocks."""
    length = sum(len(b.text) for b in blocks)
    if not length:
        return 0.0
    marks, links = sum(len(PUNCTUATION.findall(b.text)) for b in blocks), sum(min(b.link, len(b.text)) for b in blocks)
    return length / len(blocks) * (marks / len(blocks) + 0.1) * (1 - links / length)


def _cleared(elements: list[Element], blocks: list[Block]) -> set[int]:
    """Suspects inside of an article or main element that are content by their own ratios."""
    members: dict[int, list[Block]] = defaultdict(list)
    rest: list[Block] = []
    for b in blocks:
        outer = next((e for e in b.chain if elements[e].boiler == 1), 0)
        if not outer and any(elements[e].inside for e in b.chain):
            rest.append(b)
        elif elements[outer].inside:
            for e in b.chain:
                if elements[e].boiler == 1:
                    members[e].append(b)
    # an article that is in suspects alone has nothing to be compared with, and is content
    limit = _ratio(rest)
    return {e for e, mine in members.items() if _ratio(mine) >= limit or all(b.path.endswith("/h1") for b in mine)}


def blocks_of(page: str) -> tuple[list[Block], list[Element]]:
    """Text blocks outside boilerplate in page order, and all elements."""
    read = Reader(page)
    elements, blocks = read.elements, [b for b in read.blocks if not any(read.elements[e].boiler == 2 for e in b.chain)]
    wrappers = _cleared(elements, blocks)
    while True:
        # of each block, the outermost suspect element, if any
        outer = [next((e for e in b.chain if elements[e].boiler and e not in wrappers), 0) for b in blocks]
        plain: dict[int, int] = defaultdict(int)
        for b, e in zip(blocks, outer, strict=True):
            plain[e] += max(0, len(b.text) - b.link)
        whole, outside = sum(plain.values()), plain.pop(0, 0)
        largest = max(plain, key=plain.get, default=0)
        if not largest or outside >= OUTSIDE * whole or plain[largest] < WRAPPER_CHARS or 2 * plain[largest] < whole:
            return [b for b, e in zip(blocks, outer, strict=True) if not e], elements
        wrappers.add(largest)


def smooth(values: list[float]) -> list[float]:
    """Weights 1, 2, 1 over neighbours in page order."""
    n = len(values)
    return [(values[max(i - 1, 0)] + 2 * values[i] + values[min(i + 1, n - 1)]) / 4 for i in range(n)]


def content_paths(blocks: list[Block]) -> set[str]:
    """Paths whose smoothed and fused ratios pass the page's threshold."""
    length, marks, links, count = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for b in blocks:
        length[b.path] += len(b.text)
        marks[b.path] += len(PUNCTUATION.findall(b.text))
        links[b.path] += min(b.link, len(b.text))
        count[b.path] += 1
    text_ratio = smooth([length[b.path] / count[b.path] for b in blocks])
    mark_ratio = smooth([marks[b.path] / count[b.path] for b in blocks])
    fused: dict[str, list[float]] = defaultdict(list)
    for b, t, p in zip(blocks, text_ratio, mark_ratio, strict=True):
        fused[b.path].append(t * (p + 0.1) * (1 - links[b.path] / length[b.path]))
    score = {path: sum(v) / len(v) for path, v in fused.items()}
    whole = sum(length.values())
    mean = sum(score[p] * length[p] for p in score) / whole  # by text, so that many short menu paths don't pull it down
    spread = (sum((score[p] - mean) ** 2 * length[p] for p in score) / whole) ** 0.5
    return {p for p in score if score[p] > 0 and score[p] >= min(mean - spread, 0.5 * mean)} or {max(score, key=score.get)}


def main_text(page: str | None) -> str:
    """The article's text."""
    blocks, elements = blocks_of(page or "")
    if not blocks:
        return ""
    paths = content_paths(blocks)
    chosen = [b.path in paths for b in blocks]
    held: dict[int, int] = defaultdict(int)
    for b, c in zip(blocks, chosen, strict=True):
        if c:
            for e in b.chain:
                held[e] += len(b.text)
    total = held[0]
    deepest = lambda least: max(e for e, size in held.items() if size >= least and elements[e].tag not in LEAVES)  # noqa: E731  later elements lie deeper
    home, core = deepest(total), deepest(SHARE * total)
    article = [e for e in held if elements[e].tag in ("article", "main") and held[e] >= SHARE * total]
    if article:
        core = max(article)
    own = {e for e in (home, core) if elements[e].tag in ("article", "main") or elements[e].words & ARTICLE_WORDS}
    places = [i for i, c in enumerate(chosen) if c]
    keep = []
    for i, b in enumerate(blocks):
        teaser = 5 * b.link >= 4 * len(b.text) and b.path.rsplit("/", 1)[1] not in LEAVES
        near = i > places[0] and 2 * b.link < len(b.text) or i < places[0] and re.search(r"/h[1-3]$", b.path)
        if chosen[i] or (not own.isdisjoint(b.chain) and not teaser) or (home in b.chain and near):
            keep.append(b.text)
    return " ".join(keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, main text and its length in code points of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    kind = lambda c: pages.schema[c].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind(id_col)}, `{url_col}` {kind(url_col)}, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
