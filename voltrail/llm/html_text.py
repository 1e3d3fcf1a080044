"""Main text of web pages, with site templates removed.

A page is read once by a tolerant tokenizer that keeps a stack of open elements. Every closed container gets the hash of
its subtree: tag, text and the hashes of its children. Spark counts beside how many different stories of a host each hash
occurs, and a subtree that recurs beside many of them (``MIN_PAGES``, or their square root on hosts with more than a hundred) is a
template of the site, however small its share of a large host. Versions of an article count once (``Page.story``), so that they do
not make a template of it. Hosts, subtrees and pages meet by hashes in shuffles; no list of a whole host is made. The second
reading deletes those subtrees, and with them what markup names as no content: menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts and styles. A class or an id never drops what holds the page's only article, main or h1.

The main text lies in the ``article`` elements that hold an h1. Where the h1 stands outside of all of them, it is the text around
that h1 if it has at least as many words as the longest article (which then is a teaser), and otherwise, or without an h1, the
articles, else ``main``, else the page. Paragraphs, headings, tables, figures and definition lists there are the page's own words and
never taken for a template.

Text is cut at block elements. Character references are decoded, white space inside a block becomes one blank, and
blocks are joined by a line feed.

Defined results: a null or empty page has the text ''. A null url, or one without ``://``, belongs to the empty host. An
empty table gives no rows. Repeated rows and ids stay, each with its text. Very long pages are read whole, in time that grows with
their length. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from voltrail.llm.common import arrow_map, store, text_of
from voltrail.llm.url_filter import host_of

#: A subtree is a template when it occurs beside so many different main texts of its host, and beside the square root of all of them.
MIN_PAGES = 10

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
                  "section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never content.
DROPPED = frozenset("script style noscript template iframe object embed svg math canvas audio video nav footer aside form button "
                    "select textarea input label dialog menu head title xmp noembed noframes".split())
#: Elements that end with their own tag where it closes itself, as do all elements in svg and math.
FOREIGN = ("svg", "math")
#: Elements of the main text that are never a template.
OWN = frozenset("p table figure dl".split())
#: Containers whose subtrees are hashed.
CONTAINER = frozenset("div section ul ol dl table nav header footer aside form figure details p center fieldset".split())
#: Words of a class or an id that name no content wherever they stand,
NEVER_CONTENT = frozenset("advert adverts advertisement advertising adbox sponsored gdpr nav navbar breadcrumb breadcrumbs sidebar footer "
                          "masthead topbar toolbar disqus newsletter paywall pagination pager".split())
#: Names of what readers write.
READERS = frozenset("comment comments reply replies respond".split())
#: and words that do so alone or with others of these kinds: "share-buttons" is none, "related-work" is content.
NO_CONTENT = frozenset("ad ads banner sponsor promo promotion cookie cookies consent notice notices notification alert menu navigation comment "
                       "comments reply replies respond share sharing social related recommended subscribe signup login popup modal overlay "
                       "widget aside copyright".split())
#: The same outside an article, whose own header holds its title.
SITE_ONLY = frozenset(["header"])
NEUTRAL = frozenset("area articles bar block body bottom box button buttons col column container content form group holder icon icons inner item "
                    "items left link links list main outer page panel placeholder posts right row section site slot stories thread top unit wrap "
                    "wrapper".split())
#: What a name says after the first of these, or before the last, is how an element looks: "has-sidebar", "share-enabled".
BEFORE, AFTER = frozenset("has have is no non not hide show use with without".split()), frozenset("disabled enabled off on".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: An opening tag closes an open element of these names, up to the given boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}

_TAG = regex.compile(r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|[!?/][^>]*(?:>|\Z)|[a-zA-Z][^<]*\Z)""", regex.S)
_NAMES = regex.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", regex.I)
_WORDS = regex.compile(r"[a-z0-9]+")


def _is_no_content(name: str, outside: bool) -> bool:
    """Whether one name of a class or an id says that its element is no content."""
    words = _WORDS.findall(name)
    if words and words[-1] in AFTER:
        return False
    words = words[:next((i for i, w in enumerate(words) if w in BEFORE), len(words))]
    if not NEVER_CONTENT.isdisjoint(words):
        return True
    return _is_all(words, NO_CONTENT | SITE_ONLY if outside else NO_CONTENT)


def _is_all(words: list[str], kinds: frozenset[str]) -> bool:
    """Whether the words that tell something are all of these kinds, and there are some."""
    telling = [w for w in words if w not in NEUTRAL and not w.isdigit()]
    return bool(telling) and kinds.issuperset(telling)


def _judge_article(attributes: str) -> tuple[bool, bool]:
    """Whether the class or id of an ``article`` names no content (words of layout tell nothing here), and whether it names readers' words."""
    names = [_WORDS.findall(v) for name, value in _NAMES.findall(attributes) if name.lower() in ("class", "id")
             for v in value.strip("\"'").lower().split()]
    return any(_is_all(words, NO_CONTENT) for words in names), any(_is_all(words, READERS) for words in names)


def _judge(attributes: str, outside: bool) -> tuple[bool, bool]:
    """Whether an element is hidden or has a role that is no content, and whether its class or id names no content."""
    hidden = named = False
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            named = named or any(_is_no_content(v, outside) for v in value.split())
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
    return hidden, named


class Named:
    """An element that its class or id names no content. Whether it is dropped shows when the page is read: not if its scope (the next
    such element around it, else the page) has no other article or main, or heading h1, than those in it."""

    def __init__(self, scope: Named | None, first: int = 0):
        self.scope, self.first, self.last = scope, first, first
        self.own = [False, False]  # an h1, an article or main directly in it
        self.holds = [False, False]  # the same, or in a named element in it
        self.dropped = False

    def has(self, kind: int) -> None:
        self.own[kind] = True
        at = self
        while at and not at.holds[kind]:
            at.holds[kind] = True
            at = at.scope

    def decide(self) -> None:
        wrapper = self.holds[1] and not self.scope.own[1] or not self.holds[1] and self.holds[0] and not self.scope.own[0]
        self.dropped = self.scope.dropped or not wrapper


class Page:
    """One reading of a page. ``templates``: hashes of subtrees to delete."""

    def __init__(self, html: str, templates: frozenset[int] = frozenset()):
        self.templates = templates
        self.hashes: set[int] = set()
        # (region, article, kind, text): region 2 in an article, 1 in main, 0 elsewhere; outermost article; kind H1, P or neither
        self.blocks: list[tuple[int, int, str, str]] = []
        self.open: list[list] = []  # tag, dropped, hash parts, first block, named element, whether it holds a table
        self.articles = 0
        self.counts: Counter = Counter()
        self.dropped = 0
        self.words: list[str] = []
        self.marks: list[tuple[int, Named]] = []  # region that opens, scope
        self.cuts: list[tuple[int, int]] = []  # spans of blocks that templates delete
        self.page = self.scope = Named(None)
        self.named: list[Named] = []
        self._read(html)
        while self.open:
            self._close()
        self._flush()
        for named in self.named:
            named.decide()
        self.regions = max((region for region, scope in self.marks if not scope.dropped), default=0)
        self.kept = self._uncut()
        self.main = self._choose()

    def _uncut(self) -> list[tuple[int, int, str, str]]:
        kept, at = [], 0
        for first, last in [*sorted(self.cuts + [(n.first, n.last) for n in self.named if n.dropped]), (len(self.blocks), 0)]:
            kept += self.blocks[at:first]
            at = max(at, last)
        return kept

    def _choose(self) -> list[tuple[int, int, str, str]]:
        """The blocks of the main text."""
        titled = {article for region, article, kind, _ in self.kept if kind == "h1" and region == 2}
        if titled:
            return [b for b in self.kept if b[0] == 2 and b[1] in titled]
        place = max((b[0] for b in self.kept if b[2] == "h1"), default=None)
        if place is not None and self.regions > place or place == 1:
            words: Counter = Counter()
            begun = False
            for region, article, kind, text in self.kept:
                begun = begun or kind == "h1" and region == place
                if kind != "h1" and (region != place or begun):
                    words[region, article if region == 2 else 0] += len(text.split())
            if words[place, 0] and words[place, 0] >= max(n for (region, _), n in words.items() if region >= place):
                return [b for b in self.kept if b[0] == place]
        return [b for b in self.kept if b[0] >= self.regions]

    def text(self) -> str:
        return "\n".join(b[3] for b in self.main)

    def story(self) -> str:
        """What versions of an article have in common: an article's h1; main's h1 and first paragraph; else all paragraphs; else the text."""
        titles = [b for b in self.main if b[2] == "h1" and b[0]]
        own = [b[3] for b in (self.main if titles or not any(b[2] == "h1" for b in self.main) else self.kept) if b[2] == "p"]
        if titles:
            return "\n".join([b[3] for b in titles] + ([] if titles[0][0] == 2 else own[:1]))
        return "\n".join(own) or self.text()

    def _region(self) -> int:
        return 2 if self.counts["article"] else 1 if self.counts["main"] else 0

    def _flush(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            if text:
                kind = "h1" if self.counts["h1"] else "p" if self.counts["p"] else ""
                self.blocks.append((self._region(), self.articles, kind, text))
            self.words = []

    def _say(self, text: str) -> None:
        if not text:
            return
        if self.open and not text.isspace():
            self.open[-1][2].append(" ".join(text.split()))
        if not self.dropped:
            self.words.append(unescape(text) if "&" in text else text)

    def _close(self) -> None:
        tag, dropped, parts, first, named, table = self.open[-1]
        if tag in BLOCK:
            self._flush()
        self.open.pop()
        self.counts[tag] -= 1
        self.dropped -= dropped
        if named:
            self._flush()
            named.last, self.scope = len(self.blocks), named.scope
        own = xxhash.xxh3_64_intdigest("\x1f".join([tag, *parts])) - (1 << 63)
        if self.open:
            self.open[-1][2].append(f"#{own}")
            self.open[-1][5] = table = table or tag == "table"
        if parts and tag in CONTAINER and not (self._region() and (tag in OWN or table)):
            self.hashes.add(own)
            if own in self.templates:
                self.cuts.append((first, len(self.blocks)))

    def _close_to(self, names: set[str], bounds: set[str]) -> None:
        if any(self.counts[n] for n in names):
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth][0] in names:
                    while len(self.open) > depth:
                        self._close()
                    return
                if self.open[depth][0] in bounds:
                    return

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            tag = _TAG.search(html, at)
            if tag is None:
                self._say(html[at:])
                return
            self._say(html[at:tag.start()])
            at = tag.end()
            name = tag[2]
            if not name:
                continue
            name = name.lower()
            if tag[1]:
                if name in BLOCK:
                    self._flush()
                if self.counts[name]:
                    while self.open[-1][0] != name:
                        self._close()
                    self._close()
                continue
            if name in BLOCK:
                self._flush()
                if name in CLOSES:
                    self._close_to(*CLOSES[name])
                elif self.counts["p"]:
                    self._close_to({"p"}, {"article", "main", "td", "div", "section", "button"})
            if name == "br":
                self.words.append(" ")
            if name in VOID:
                continue
            attributes = tag[3]
            outside = not self.counts["article"]
            closed = attributes.endswith("/") and (name in FOREIGN or any(self.counts[f] for f in FOREIGN))
            if closed:
                if self.open:
                    self.open[-1][2].append(f"<{name}>")
                continue
            hidden, named = _judge(attributes, outside) if attributes and name not in ("html", "body", "article", "main") else (False, False)
            readers = False
            if name == "article":
                named, readers = _judge_article(attributes) if attributes else (False, False)
                self.articles += outside
            wraps = name in BLOCK or "-" in name  # what stands in a line holds no article
            dropped = int(name in DROPPED or name == "header" and outside or hidden or named and not wraps)
            if named and wraps:
                self._flush()
                named = self.scope = Named(self.scope, len(self.blocks))
                self.named.append(named)
            else:
                named = None
            self.open.append([name, dropped, [], len(self.blocks), named, False])
            self.counts[name] += 1
            self.dropped += dropped
            if not self.dropped and name in ("article", "main", "h1"):
                if name != "h1":
                    self.marks.append((2 if name == "article" else 1, self.scope))
                if not readers:
                    self.scope.has(int(name != "h1"))
            if name in RAW:
                close = regex.compile(rf"</{name}(?=[\s/>])", regex.I).search(html, at)
                stop = close.start() if close else end
                if name not in ("script", "style"):
                    self._say(html[at:stop])
                at = stop


def subtrees(pages: DataFrame) -> DataFrame:
    """``pages``: (key, host, html). Rows (key, host, story, hashes): the hash of the story and those of all subtrees of each page."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stories, hashes = [], []
            for html in batch.column(2):
                page = Page(html.as_py())
                stories.append(xxhash.xxh3_64_intdigest(page.story()) - (1 << 63))
                hashes.append([*page.hashes])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(stories, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
                                  ["key", "host", "story", "hashes"])

    return store(arrow_map(pages, read, "key long, host long, story long, hashes array<long>"), "subtrees")


def templates(found: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, hash) of the subtrees that recur beside many stories of their host."""
    hosts = found.groupBy("host").agg(F.count_distinct("story").alias("stories"))
    counts = found.select("host", "story", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count_distinct("story").alias("n"))
    return store(counts.where(F.col("n") >= min_pages).join(hosts, "host").where("n >= sqrt(stories)").select("host", "hash"), "templates")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_templates (subtrees of the site's templates on the page)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for html, hashes in zip(batch.column(2), batch.column(3)):
                known = frozenset(hashes.as_py() or ())
                page = Page(html.as_py(), known)
                texts.append(page.text())
                found.append(len(page.hashes & known))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                   pa.array(list(map(len, texts)), pa.int64()), pa.array(found, pa.int64())],
                                  ["page_id", "url", "text", "n_chars", "n_templates"])

    # pages that are alike in host and html have one key, as they have the same templates
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"),
                        F.xxhash64(host_of(text_of(url_col))).alias("host")).withColumn("key", F.xxhash64("host", "html"))
    found = subtrees(rows.select("key", "host", "html"))
    known = found.select("key", "host", F.explode("hashes").alias("hash")).join(templates(found), ["host", "hash"]) \
        .groupBy("key").agg(F.collect_set("hash").alias("hashes"))
    marked = rows.join(known.hint("merge"), "key", "left").select("page_id", "url", "html", "hashes")
    kinds = {c: marked.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return arrow_map(marked, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_templates long")
