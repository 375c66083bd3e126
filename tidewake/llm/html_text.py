"""Main text of web pages by tree scoring.

A page becomes a tree of elements and text blocks. What is no text by its element, such as menus,
footers and scripts, is left out; elements whose names say that they are no part of the article are
left out too, unless the article is inside them (see ``Page``). Each paragraph passes points for its length
and commas to its ancestors, less with distance; an element's points are discounted by the share
of its text inside links. The best container, text around it with few links,
and its worthy siblings are kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head nav footer aside button select option input textarea script style noscript template svg math iframe object embed canvas audio video map dialog menu title label".split())
#: Left out unless the article is inside, as some pages are a form as a whole.
FORMS = frozenset("form fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd section div article main".split())
#: Start tags that end an open <p>; a few end their own kind.
ENDS_ITSELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
# Words of class, id and role names that mark what is not the article.
UNWANTED = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner
nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar
comment comments disqus reply replies respond discussion notice notices alert cookie cookies consent gdpr popup modal overlay
share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager
widget toolbar skip toc complementary contentinfo""".split())
WANTED = frozenset("article content main post entry story body text".split())
# Words that go with those above in the names of such parts.
PLAIN = frozenset("""box wrap wrapper container list area block link links bar button buttons icon icons item items group panel section widget inner outer
top bottom left right center primary secondary global site page header title row col column module region latest recent popular more user reader our your
js wp id el""".split())

MARKUP = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?/]")
QUOTE_OR_END = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Element:
    """``block``: the nearest element, from itself, that is not inline; ``depth``: of its place in the tree."""

    __slots__ = ("tag", "parent", "depth", "block", "in_article", "dropped", "doubt", "holds", "wanted", "points", "chars", "linked")

    def __init__(self, tag: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.block = parent.block if parent and tag in INLINE else self
        self.in_article = tag in ("article", "main") or bool(parent and parent.in_article)
        self.dropped = bool(parent and parent.dropped)
        self.doubt = 0  # whether its names speak against it: 1 by a part of a name, 2 by a whole one
        self.holds = False  # an article or main element
        self.wanted = tag in ("article", "main")
        self.points = 0.0
        self.chars = self.linked = 0

    @property
    def link_density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0

    @property
    def rank(self) -> float:
        return (self.points + 25 * (self.tag in ("article", "main")) + 5 * self.wanted) * (1 - self.link_density)


def _element(tag: str, attributes: str, parent: Element) -> Element:
    out = Element(tag, parent)
    if tag in ("html", "body", "main"):
        return out
    if tag == "article":
        if attributes and not out.dropped:  # comments are often articles
            out.doubt = 2 * (_names(attributes)[2] == 2)
        return out
    out.dropped = out.dropped or tag in DROPPED or (tag == "header" and not parent.in_article)
    out.doubt = 2 * (tag in FORMS)
    if attributes and not out.dropped and tag not in INLINE:
        found, named, doubt = _names(attributes)
        out.dropped = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        out.wanted = bool(named & WANTED)
        out.doubt = max(out.doubt, doubt)
        if "header" in named and not parent.in_article and not out.wanted:
            out.doubt = 2
    return out


def _names(attributes: str) -> tuple[dict[str, str], set[str], int]:
    """The attributes, the words in its class, id and role, and what they say against it.

    A name such as ``sidebar`` or ``related-links`` does so as a whole, one such as ``has-sidebar`` or
    ``notice-of-default`` by a part.
    """
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    named, doubt = set(), 0
    for k in ("class", "id", "role"):
        for name in found.get(k, "").split():
            words = {p.lower() for p in NAME_PARTS.findall(name)}
            named |= words
            if words & UNWANTED:
                doubt = max(doubt, 1 if any(len(w) > 1 and not w.isdigit() for w in words - UNWANTED - PLAIN) else 2)
    return found, named, doubt


class Page:
    """The elements and blocks of text of a page, in page order; its work is in proportion to the page.

    An element whose names speak against it is left out with all that is in it, unless it is the
    article's own surroundings or part of it. Where an article (or main element) stands in no such
    element, that is those inside it of which only a part of a name speaks so. Else it is those with
    more than half of the page's text outside links, which must hold an article if there is one;
    of those with only a part of a name, any that hold an article or a fifth of the text.
    """

    def __init__(self, page: str):
        self.page, self.node = page, Element("#root", None)
        self.elements, self.blocks = [self.node], []  # blocks: innermost element, text, characters inside links
        self.open: dict[str, list[Element]] = {}
        self.pieces: list[str] = []
        self.inside = 0
        self.lost: set[int] = set()  # quotes behind which no tag ends
        self.last_quote = {q: page.rfind(q) for q in "\"'"}
        self.last_end = page.rfind(">")
        self._read()
        self._add_up()
        if any(x.doubt for x in self.elements):
            self._leave_out()

    def _add_up(self) -> None:
        for x in self.elements[:0:-1]:
            x.parent.chars += x.chars
            x.parent.linked += x.linked
            x.parent.holds = x.parent.holds or x.holds or (x.tag in ("article", "main") and x.doubt < 2 and x.chars > 0)

    def _leave_out(self) -> None:
        """Leave out elements that names speak against, and add up the text that stays."""
        doubted: set[int] = set()  # elements in doubt, and all in them
        clear = False
        for x in self.elements[1:]:
            if x.doubt or id(x.parent) in doubted:
                doubted.add(id(x))
            else:
                clear = clear or (x.tag in ("article", "main") and x.chars > 0)
        some = self.elements[0].holds
        whole = self.elements[0].chars - self.elements[0].linked
        for x in self.elements[1:]:
            x.dropped = x.dropped or x.parent.dropped
            if x.doubt and not x.dropped:
                if clear:
                    x.dropped = x.doubt == 2 or not x.parent.in_article
                elif x.doubt == 2:
                    x.dropped = x.chars - x.linked <= whole / 2 or (some and not x.holds)
                else:
                    x.dropped = x.chars - x.linked <= whole / 5 and not (x.holds or x.in_article)
        self.blocks = [b for b in self.blocks if not b[0].dropped]
        for x in self.elements:
            x.chars = x.linked = 0
        for owner, joined, linked in self.blocks:
            owner.chars += len(joined)
            owner.linked += linked
        self._add_up()

    def _text(self, raw: str) -> None:
        if raw and not self.node.dropped:
            raw = html.unescape(raw)
            self.pieces.append(raw)
            if self.open.get("a"):
                self.inside += len(raw.strip())

    def _flush(self) -> None:
        if self.pieces:
            joined = " ".join("".join(self.pieces).split())
            if joined:
                owner, linked = self.node.block, min(self.inside, len(joined))
                self.blocks.append((owner, joined, linked))
                owner.chars += len(joined)
                owner.linked += linked
            self.pieces, self.inside = [], 0

    def _innermost(self, *tags: str) -> Element | None:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), key=lambda x: x.depth, default=None)

    def _close(self, to: Element) -> None:
        while self.node is not to.parent:
            self.open[self.node.tag].pop()
            self.node = self.node.parent

    def _tag_end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``: a > outside quotes, or the first if its quotes lead nowhere.

        Quotes that have led nowhere are remembered, so that each is followed once.
        """
        page, here, seen = self.page, at, []
        while m := QUOTE_OR_END.search(page, here):
            if m[0] == ">":
                return m.start()
            seen.append(m.start())
            if m.start() in self.lost or m.start() >= self.last_quote[m[0]]:
                break
            here = page.find(m[0], m.end()) + 1
        self.lost.update(seen)
        return page.find(">", at)

    def _read(self) -> None:
        page, at, end = self.page, 0, len(self.page)
        while at < end:
            m = MARKUP.search(page, at)
            if m is None or (m[2] and m.end() > self.last_end):
                self._text(page[at:])
                break
            self._text(page[at : m.start()])
            if not m[2]:
                close = "-->" if m[0] == "<!--" else ">"
                stop = page.find(close, m.end())
                at = end if stop < 0 else stop + len(close)
                continue
            stop = self._tag_end(m.end())
            attributes, tag = page[m.end() : stop], m[2].lower()
            at = stop + 1
            if m[1]:
                if tag not in INLINE:
                    self._flush()
                if target := self._innermost(tag):
                    self._close(target)
            elif tag == "br":
                self._text(" ")
            else:
                at = self._start(tag, attributes, at)
        self._flush()

    def _start(self, tag: str, attributes: str, at: int) -> int:
        if tag not in INLINE:
            self._flush()
            if paragraph := self._innermost("p"):
                self._close(paragraph)
            if tag in ENDS_ITSELF:
                same, around = self._innermost(tag), self._innermost(*ENDS_ITSELF[tag])
                if same and (around is None or same.depth > around.depth):
                    self._close(same)
        if tag in VOID or (attributes.rstrip().endswith("/") and tag in ("svg", "path", "use")):
            return at
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(self.page, at)
            return stop.end() if stop else len(self.page)
        self.node = _element(tag, attributes, self.node)
        self.elements.append(self.node)
        self.open.setdefault(tag, []).append(self.node)
        return at


def main_text(page: str) -> str:
    """The article's blocks joined by newlines; empty if there are none."""
    read = Page(page)
    candidates: dict[int, Element] = {}
    for owner, body, linked in read.blocks:
        if owner.tag in PARAGRAPHS or owner.tag in ("#root", "body"):
            points = (1 + body.count(",") + min(len(body) / 100, 3)) * (1 - linked / len(body))
            x = owner if owner.tag not in ("p", "pre", "td", "li", "dd", "blockquote") else owner.parent or owner
            x = owner if x.tag == "#root" else x
            for share in (1, 2, 6, 9, 12, 15):
                x.points += points / share
                candidates[id(x)] = x
                x = x.parent
                if x is None or x.tag == "#root":
                    break
    if not candidates:
        return ""
    best = max(candidates.values(), key=lambda x: x.rank)
    x = best
    while x is not None and x.tag != "article":
        x = x.parent
    best = x or best
    # without an article, the text around the best container belongs to it unless much of it is links
    while best.tag not in ("article", "main", "body", "#root") and best.parent.tag not in ("html", "body", "#root") and best.parent.link_density < 0.25:
        best = best.parent
    least = max(10.0, 0.2 * best.rank)

    def worthy(x: Element) -> bool:
        """Whether a sibling of the best container is kept; beside an article, only another one."""
        if best.tag == "article":
            return x.tag == "article" and 0 < x.points and x.points * (1 - x.link_density) >= 0.2 * best.points * (1 - best.link_density)
        if best.tag in ("body", "#root"):
            return False
        return x.tag in ("h1", "h2") or (best.tag != "main" and x.link_density < 0.25) or (id(x) in candidates and x.rank >= least)

    # an element is kept with its parent, but for lists and boxes of links outside articles
    kept = {id(best)}
    for x in read.elements[1:]:
        if x is best:
            continue
        if x.parent is best.parent:
            keep = worthy(x)
        else:
            keep = id(x.parent) in kept and not (best.tag != "article" and x.tag in ("ul", "ol", "div", "table", "section", "dl") and x.link_density > 0.6)
        if keep:
            kept.add(id(x))
    return "\n".join(body for owner, body, linked in read.blocks if id(owner) in kept)


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with the main ``text`` of each row's whole html and its length ``n_chars`` in code points.

    Character references are decoded, white space within a block becomes one space and blocks are
    joined by a newline. Of several articles side by side those of a fifth of the best one's points
    or more are kept. A null or empty html, or one without text, gives an empty text.
    The html column is left out; columns named text or n_chars are replaced; repeated rows stay.
    """
    rest = [c for c in pages.columns if c not in (column, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py() or "") for x in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], [*rest, "text", "n_chars"])

    schema = T.StructType([*(pages.schema[c] for c in rest), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*rest, column).mapInArrow(run, schema)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages)
