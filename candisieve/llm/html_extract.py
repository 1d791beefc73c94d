"""Main text of web pages by removal of site templates.

Every page is read into its elements. Element subtrees are hashed and counted per host over pages of
different main text, inside articles over pages of different titles; subtrees that recur across many of
them belong to the site's template and are deleted, as are elements whose kind or name says that they are
no article text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candisieve.session import materialize

# A subtree is a template if it recurs on at least so many different pages of a host and on this share of
# them; outside articles also on so many pages whatever their share, so that a hot host's sections do not ask
# for ever more. Lines that many articles share stay in them at every size of the host.
LEAST_PAGES, SHARE, MANY_PAGES = 5, 0.3, 1_000

# Fixed values of HTML: elements without content, with raw content, inside a line of text, and
# those whose start closes an open element of the same group.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output q ruby rt rp s samp"
    " small span strike strong sub sup time tt u var wbr".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr main menu nav ol p pre search section summary table ul".split())
GROUPS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
# What an implied end of an item does not reach beyond.
WALLS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"),
         "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}

# Elements that hold no article text, by kind, by name in class or id, and by role.
DROPPED = frozenset("head nav footer aside form button dialog menu".split()) | RAW
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar cookie cookies consent"
    " gdpr notice notices alert comment comments commentlist disqus respond replies menu nav navbar navigation breadcrumb breadcrumbs"
    " footer masthead share sharing social newsletter subscribe subscription signup login related recommended recommendations popup modal"
    " overlay widget pagination pager toolbar skip".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
KEPT = frozenset("html body main article".split())

# Raw content ends where a browser would end it or a page's body starts, if that comes before the end tag.
BREAKS = {
    "select": re.compile(r"<(?:select|input|textarea|article|main)\b", re.I),
    "svg": re.compile(r"<(?:article|main|div|p|h[1-6]|ul|ol|table)\b", re.I),
    "math": re.compile(r"<(?:article|main|div|p|h[1-6]|ul|ol|table)\b", re.I),
    "object": re.compile(r"<(?:article|main)\b", re.I)}
FOREIGN = re.compile(r"<(?:foreignobject|annotation-xml)\b", re.I)
# Without an end tag these still hold code or a name up to the next tag; others then hold nothing.
CODE = frozenset("script style title textarea".split())
# Levels of content: an article in a dropped element, plain, in a main part, in an article.
RESCUED, PLAIN, MAIN, ARTICLE = -1, 0, 1, 2

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)")
# A tag whose quoted parts hold no other; it fails before the next "<", so it is tried at every one.
_PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><"']*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_SPECIAL = re.compile(r"""[>"']""")
_ZEROS, _HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.I)
_PART = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def decoded(raw: str) -> str:
    """Character references decoded; numbers too large for any character give the stand-in, at every length."""
    return unescape(_HUGE.sub("\ufffd", _ZEROS.sub("&#", raw)) if "&#" in raw else raw)


class Tags:
    """The tags of a page in order, in time linear in its length however broken it is.

    A tag ends at the first ``>`` outside quotes; a quote that is never closed is none, and a ``<``
    without such an end is text. What a failed look for an end has seen is remembered, so it is not
    searched again from the next ``<``.
    """

    def __init__(self, html: str):
        self.html = html
        self.last_end = html.rfind(">")
        self.last = {quote: html.rfind(quote) for quote in "\"'"}
        self.special: tuple[int, int] = (0, -1)
        self.dead: set[int] = set()

    def next_special(self, at: int) -> int:
        """The next ``>`` or quote."""
        if not self.special[0] <= at <= self.special[1]:
            found = _SPECIAL.search(self.html, at)
            self.special = (at, found.start() if found else len(self.html))
        return self.special[1]

    def end(self, at: int) -> int:
        met = []
        while True:
            at = self.next_special(at)
            if at > self.last_end or at in self.dead:
                self.dead.update(met)
                return -1
            char = self.html[at]
            if char == ">":
                return at
            met.append(at)
            at = (self.html.find(char, at + 1) if at < self.last[char] else at) + 1

    def next(self, at: int) -> tuple[int, int, str, str, bool] | None:
        """``start, after, name, attributes, closing`` of the next tag; comments and declarations have no name."""
        html = self.html
        while (start := html.find("<", at)) >= 0:
            at = start + 1
            if plain := _PLAIN_TAG.match(html, start):
                closing, name, attributes = plain.groups()
                return start, plain.end(), name.lower(), attributes, bool(closing)
            if html.startswith("<!--", start):
                stop = html.find("-->", start + 4)
                return start, stop + 3 if stop >= 0 else len(html), "", "", False
            if start > self.last_end:
                if (comment := html.find("<!--", start)) < 0:
                    return None
                at = comment
            elif html[at] in "!?":
                return start, html.index(">", start) + 1, "", "", False
            elif (name := _NAME.match(html, start)) and (stop := self.end(name.end())) >= 0:
                return start, stop + 1, name.group(2).lower(), html[name.end(): stop], bool(name.group(1))
        return None


def named_away(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is no article text by its kind, names or role."""
    if tag in KEPT:
        return False
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes or not ("class" in attributes or "id" in attributes or "role" in attributes):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in ROLES):
            return True
        if name in ("class", "id"):
            for word in value.split():
                parts = _PART.findall(_CAMEL.sub("-", word).lower())
                if parts and not {"no", "has", "with", "without"} & set(parts) and (
                        parts[0] in NAMES or parts[-1] in NAMES or (parts[-1] == "header" and not in_article)):
                    return True
    return False


class Page:
    """The blocks of a page with the subtrees that hold them, read in one pass.

    A main part is kept wherever it lies, an article as well in a form or behind a dropped element
    without an end. An article in another dropped element (a comment, a teaser, or the page's body in
    a wrapper) is kept apart for pages without a better text. A form that holds most of the page is
    no form but its body. A page left without any text is read again, with names, forms and open ends
    ignored.

    ``templates`` are hashes of subtrees to delete. Afterwards ``blocks`` is the kept text by block
    and ``subtrees`` the hashes of all block elements with text, ``inside`` those of them in an article.
    """

    def __init__(self, html: str, templates: frozenset[int] = frozenset()):
        self.templates = templates
        self.blocks: list[tuple[str, int]] = []
        self.subtrees: set[int] = set()
        self.inside: set[int] = set()
        self.title = ""
        self.line: list[str] = []
        self.html = html
        self.tags = Tags(html)
        self.ends: dict[str, re.Match | None] = {}
        self.open_kinds: Counter[str] | None = None
        self.lenient = self.any_text = self.any_lost = self.any_article = False
        self.read_all()
        if self.any_lost and not self.any_text:
            self.lenient = True
            self.read_all()

    def read_all(self) -> None:
        # Open elements: kind, whether dropped (1 by an outer element, 2 by itself), first block, parts
        # of the hash, level of content.
        self.open: list[tuple[str, int, int, list[bytes], int]] = [("", 0, 0, [], PLAIN)]
        # Where open elements of a kind stand, and those dropped by themselves; articles that are not dropped.
        self.places: dict[str, list[int]] = defaultdict(list)
        self.dropped_places: dict[str, list[int]] = defaultdict(list)
        self.articles = 0
        self.ends.clear()
        self.read(self.html)
        while len(self.open) > 1:
            self.close()
        self.flush()

    def unclosed(self, tag: str) -> bool:
        """Whether the page opens more elements of a kind than it closes."""
        if self.open_kinds is None:
            self.open_kinds = Counter()
            for slash, kind in _NAME.findall(self.html):
                self.open_kinds[kind.lower()] += -1 if slash else 1
        return self.open_kinds[tag] > 0

    def end_tag(self, tag: str, at: int) -> re.Match | None:
        """The next end tag of a kind; the page is searched once up to each."""
        if tag not in self.ends or ((found := self.ends[tag]) and found.start() < at):
            self.ends[tag] = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(self.html, at, self.tags.last_end + 1)
        return self.ends[tag]

    def read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            tag = self.tags.next(at)
            if tag is None:
                self.text(html[at:])
                return
            start, after, name, attributes, closing = tag
            if start > at:
                self.text(html[at:start])
            at = after
            if not name:
                continue
            if closing:
                self.end(name)
                continue
            if name in RAW and not attributes.endswith("/"):
                stop = self.end_tag(name, at)
                end, after = stop.span() if stop else (n, n)
                if stop is None:
                    following = self.tags.next(at) if name in CODE else None
                    end = after = following[0] if following else n if name in CODE else at
                elif name in BREAKS and (early := BREAKS[name].search(html, at, end)) and not FOREIGN.search(html, at, early.start()):
                    end = after = early.start()
                if name == "title" and not self.title:
                    self.title = " ".join(html[at: end].split())
                at = after
                if name not in INLINE:
                    self.flush()
                continue
            body = False
            if name == "form":
                stop = self.end_tag(name, at)
                body = 2 * ((stop.start() if stop else n) - at) > n
            self.start(name, attributes, body)

    def text(self, piece: str) -> None:
        if not self.open[-1][1]:
            self.line.append(piece)
        elif not self.any_lost and not piece.isspace():
            self.any_lost = True

    def flush(self) -> None:
        """End the current line of text as a block of the innermost element."""
        if not self.line:
            return
        raw = "".join(self.line)
        self.line = []
        block = " ".join((decoded(raw) if "&" in raw else raw).split())
        if block:
            _, _, _, parts, level = self.open[-1]
            parts.append(block.encode("utf-8", "replace"))
            self.blocks.append((block, level))
            self.any_text = True

    def away(self, tag: str, attributes: str, in_article: bool) -> bool:
        """``named_away``; on a second reading only closed elements of a dropped kind and hidden ones are."""
        if not self.lenient:
            return named_away(tag, attributes, in_article)
        if tag in DROPPED:
            return tag not in ("form", "menu", "dialog") and not self.unclosed(tag)
        return tag not in KEPT and any(
            name.lower() == "hidden" or name.lower() == "aria-hidden" and "true" in (v.lower() for v in values)
            for name, *values in _ATTRIBUTE.findall(attributes))

    def start(self, tag: str, attributes: str, body: bool = False) -> None:
        if tag == "br":
            self.flush()
            return
        if tag in CLOSES_PARAGRAPH:
            self.implied_end(("p",), ("article", "section", "div", "td", "th", "li", "blockquote", "body", "main", "button"))
        elif tag in GROUPS:
            self.implied_end(GROUPS[tag], WALLS[tag])
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        main = tag == "main" or 'role="main"' in attributes
        if self.open[-1][1] and tag == "article":
            self.end_open_dropped()
        _, dropped, _, _, level = self.open[-1]
        if dropped and tag == "article":
            reasons = {kind for kind, held in self.dropped_places.items() if held}
            again = self.articles > 0
            gone = int(again)
            inside = PLAIN if again else ARTICLE if reasons == {"form"} else RESCUED
        else:
            away = not main and not body and self.away(tag, attributes, level in (ARTICLE, RESCUED))
            gone = 2 if away else int(bool(dropped) and not main)
            inside = (PLAIN if gone else RESCUED if level == RESCUED else ARTICLE if tag == "article"
                      else max(level, MAIN) if main else level)
        if inside == ARTICLE:
            self.any_article = True
        # Inline elements add to the hash of what holds them.
        parts = self.open[-1][3] if tag in INLINE and not gone and not dropped else []
        self.places[tag].append(len(self.open))
        if gone == 2:
            self.dropped_places[tag].append(len(self.open))
        self.articles += tag == "article" and not gone
        self.open.append((tag, gone, len(self.blocks), parts, inside))

    def end_open_dropped(self) -> None:
        """End dropped elements that have no end of their own, before the page's first article."""
        if self.any_article:
            return
        first = min((held[0] for tag, held in self.dropped_places.items() if held and self.unclosed(tag)), default=0)
        while first and len(self.open) > first:
            self.close()

    def last_place(self, kinds: tuple[str, ...]) -> int:
        return max((self.places[kind][-1] for kind in kinds if self.places.get(kind)), default=0)

    def implied_end(self, group: tuple[str, ...], walls: tuple[str, ...]) -> None:
        while (k := self.last_place(group)) and (k > self.last_place(walls) or any(self.open[k][0] == wall for wall in walls)):
            while len(self.open) > k:
                self.close()
            if len(group) == 1:
                return

    def end(self, tag: str) -> None:
        if tag == "br":
            self.flush()
            return
        k = self.last_place((tag,))
        while k and len(self.open) > k:
            self.close()

    def close(self) -> None:
        """Close the innermost element: hash its subtree and delete it if it is a template's."""
        tag, dropped, first, _, level = self.open[-1]
        if tag not in INLINE:
            self.flush()
        parts = self.open.pop()[3]
        self.places[tag].pop()
        if dropped == 2:
            self.dropped_places[tag].pop()
        self.articles -= tag == "article" and not dropped
        if dropped or not parts or tag in INLINE and parts is self.open[-1][3]:
            return
        if tag in INLINE:
            self.open[-1][3].extend(parts)
            return
        digest = xxhash.xxh64_digest(tag.encode() + b"\0" + b"\1".join(parts))
        value = int.from_bytes(digest, "little", signed=True)
        if value in self.templates:
            del self.blocks[first:]
            return
        if tag not in KEPT:
            self.subtrees.add(value)
            if level in (ARTICLE, RESCUED):
                self.inside.add(value)
        self.open[-1][3].append(digest)

    def main_text(self) -> str:
        """The blocks of articles; without one those of main parts; without these the longer of what is
        left and of the articles in dropped elements."""
        best = max((level for _, level in self.blocks), default=PLAIN)
        if best == PLAIN:
            best = max((PLAIN, RESCUED), key=lambda at: sum(len(block) for block, level in self.blocks if level == at))
        return " ".join(block for block, level in self.blocks if level == best)

    def content(self) -> int:
        """Tells pages of different main text apart, whatever their titles and what surrounds their articles."""
        return xxhash.xxh64_intdigest(self.main_text().encode("utf-8", "replace")) - 2**63

    def heading(self) -> int:
        """Tells pages of different titles apart; pages without a title by their main text."""
        return xxhash.xxh64_intdigest(self.title.encode("utf-8", "replace")) - 2**63 if self.title else self.content()


def host_of(url: Column) -> Column:
    """Lower-cased host of a url; the empty text if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def subtree_rows(pages: DataFrame) -> DataFrame:
    """``host, subtree, inside, content, heading`` of ``host, html``; a row with subtree null for every page."""
    names = ["host", "subtree", "inside", "content", "heading"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(html or "")
                content, heading = page.content(), page.heading()
                rows.append((host, None, False, content, heading))
                rows += [(host, subtree, subtree in page.inside, content, heading) for subtree in page.subtrees]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

    return pages.mapInArrow(read, "host string, subtree bigint, inside boolean, content bigint, heading bigint")


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """``host, templates`` for hosts that have any, from ``host, html``.

    Pages are told apart by their main text, so copies of a page count once and pages of one title each.
    What lies inside an article is counted over titles if the host has at least ``least_pages`` of them:
    versions of an article have one title, and their common heading and lines are no template. A host's
    list is bounded by the subtrees of a page over ``share``, and by all its subtrees over ``many_pages``.
    """
    counts = subtree_rows(pages).groupBy("host", "subtree").agg(
        F.max("inside").alias("inside"), F.countDistinct("content").alias("contents"), F.countDistinct("heading").alias("headings"))
    whole = counts.where("subtree is null").select("host", F.col("contents").alias("all_contents"), F.col("headings").alias("all_headings"))
    # A host's texts may all be one where its titles differ, so either may be the smaller number.
    often = counts.where((F.greatest("contents", "headings") >= least_pages) & F.col("subtree").isNotNull()).join(whole, "host")
    by_title = F.col("inside") & (F.col("all_headings") >= least_pages)
    n = F.when(by_title, F.col("headings")).otherwise(F.col("contents"))
    of = F.when(by_title, F.col("all_headings")).otherwise(F.col("all_contents"))
    enough = (n >= least_pages) & ((n >= of * share) | (~F.col("inside") & (n >= many_pages)))
    return often.where(enough).groupBy("host").agg(F.collect_list("subtree").alias("templates"))


def extract_main_text(
    pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE, many_pages: int = MANY_PAGES,
) -> DataFrame:
    """``page_id, url, text`` of every page (``page_id, url, html``), from its whole html.

    Character references are decoded, white space within a block becomes one space, blocks are
    joined by one space in page order. Null or empty html gives the empty text; pages without a host
    are one site; repeated rows are extracted each; broken markup is read as browsers do, as far as
    implied ends go; an empty table gives no rows.
    """
    slim = pages.select(F.col("`page_id`").alias("page_id"), F.col("`url`").alias("url"), F.col("`html`").alias("html"))
    slim = slim.withColumn("host", host_of(F.col("url")))
    # Written first: its size is then known to the join, and a host with many pages can be split.
    templates = materialize(site_templates(slim.select("host", "html"), least_pages, share, many_pages), "page-templates")
    rows = slim.join(templates, "host", "left").select("page_id", "url", "html", "templates")
    kind = rows.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(html or "", frozenset(templates or ())).main_text()
                     for html, templates in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(read, f"page_id {kind}, url string, text string")
