"""Main text of web pages, with site templates removed.

Every subtree of a page that may be part of a template has two hashes, made bottom-up from those of its children: one of
its content, and one of its shape, which is its tag, the words of its class, id and role, and the shapes of its
children, each once, without any text. Spark counts, host by host, on how many pages of different content each hash
occurs. Subtrees whose content or shape recurs on ``LEAST_PAGES`` are deleted: content recurs where a notice is the same
on many pages, shape where a menu, an advert or a footer says something else on each. Shapes count outside the article
only, since those of articles recur as well; inside it, only boxes whose content recurs go, never its paragraphs.

Names of tags and classes and the place of the article decide where a host has too few pages to tell, and about
subtrees that are too rare on it.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import append, cut, fresh, table

#: A subtree is part of the template of a host if it is on so many of its pages of different content.
LEAST_PAGES = 5
#: Up to so many template subtrees (8 bytes each) go to all tasks as one broadcast; more are joined to their pages.
MOST_BROADCAST = 200_000
BLOCK = 2 << 20

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
# Tags by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BREAKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Never text of a page, on any site.
MARKUP = frozenset("head script style title noscript template textarea iframe noembed noframes xmp select input svg canvas object embed audio video".split())
CONTAINERS = frozenset("div section aside nav ul ol dl table form header footer figure details center fieldset menu".split())
ENDS_P = BREAKS - {"br", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend", "summary", "figcaption"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table select".split())
ITEMS = LISTS | SIBLINGS.keys()
KEEP_WHOLE = frozenset("html body article main".split())
#: Parts of a page by their tag: boxes of their own even without a class.
SECTIONS = frozenset("nav header footer aside form menu dialog".split())
#: Those of them that nothing is wrapped in but what belongs to them.
WHOLE = SECTIONS - {"form"}
#: Boxes that may be deleted inside an article, the second kind only if they have a class, id or role.
BOXES, NAMED_BOXES = SECTIONS | {"details", "fieldset"}, frozenset("div section figure center ul ol dl table".split())
#: Elements whose content may be a template: blocks, but no cells or rows of a table, whose values recur.
BLOCKS = BREAKS - KEEP_WHOLE - VOID - frozenset("head tbody td tfoot th thead tr legend option summary".split())
#: The core of a page without an article is the smallest of these that holds ``CORE`` of its text.
HOLDERS, CORE = frozenset("div section center table tbody tr td form main body html dl ul ol li".split()), 0.8
# Names that say what an element is, where the pages of its host can't.
NAMED_TAGS = frozenset("nav footer aside form button dialog menu".split())
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc header masthead footer contentinfo "
    "sidebar aside complementary widget widgets related recommended recommendations popular trending "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login search "
    "share sharing social comment comments respond replies disqus discussion form".split()
)
#: Inside an article these hold its title.
HEADS = frozenset("header masthead".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _words(attrs: str) -> list[str]:
    """Words of class, id and role."""
    return [w.lower() for m in _NAMES.finditer(attrs) for w in _PARTS.findall(m[1] or m[2] or m[3] or "")] if "=" in attrs else []


def _named_out(tag: str, attrs: str, inside: bool) -> bool:
    if tag in NAMED_TAGS:
        return True
    if not attrs.strip():
        return False
    if tag in KEEP_WHOLE:
        return tag == "article" and not {"comment", "comments", "ad", "sponsored", "related", "teaser"}.isdisjoint(_words(attrs))
    return not (NOT_ARTICLE - HEADS if inside else NOT_ARTICLE).isdisjoint(_words(attrs))


class Page:
    """The elements of a page: tag, attributes, parent and parts (children and texts); its texts and breaks in order."""

    def __init__(self, source: str):
        self.source = source
        self.tag, self.attrs, self.parent = ["#"], [""], [-1]
        self.parts: list[list[int | tuple[int, int]]] = [[]]
        self.flow: list[tuple[int, int, int]] = []  # element, start, end of a text; a break where start < 0
        stack, at, size = [0], 0, len(source)
        # where on the stack open elements of a tag, blocks, items of lists, and containers are: no scan of the stack
        of: dict[str, list[int]] = defaultdict(list)
        blocks, items, holders = [0], [0], [0]
        kinds = ((blocks, BREAKS), (items, ITEMS), (holders, CONTAINERS | KEEP_WHOLE))

        def close(depth: int) -> None:
            while len(stack) > depth:
                gone = self.tag[stack.pop()]
                of[gone].pop()
                for places, tags in kinds:
                    if gone in tags:
                        places.pop()

        def text(a: int, b: int) -> None:
            self.flow.append((stack[-1], a, b))
            self.parts[stack[-1]].append((a, b))

        while at < size:
            m = _TAG.search(source, at)
            if not m:
                text(at, size)
                break
            if m.start() > at:
                text(at, m.start())
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag in BREAKS:
                self.flow.append((stack[-1], -1, -1))
            if m[1]:
                # a stray end tag closes nothing; that of a paragraph or an item nothing outside its container
                if of[tag] and not (tag in ("p", "li", "dt", "dd") and holders[-1] > of[tag][-1]):
                    close(of[tag][-1])
                continue
            if tag in ENDS_P and self.tag[stack[blocks[-1]]] == "p":
                close(blocks[-1])
            if tag in SIBLINGS:
                for d in reversed(items):
                    if self.tag[stack[d]] in SIBLINGS[tag]:
                        close(d)
                        break
                    if not d or self.tag[stack[d]] in LISTS:
                        break
            k = len(self.tag)
            self.tag.append(tag)
            self.attrs.append(m[3])
            self.parent.append(stack[-1])
            self.parts[stack[-1]].append(k)
            self.parts.append([])
            if tag in RAW and not m[3].endswith("/"):
                stop = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
                at = stop.end() if stop else size
            elif tag not in VOID:
                of[tag].append(len(stack))
                for places, tags in kinds:
                    if tag in tags:
                        places.append(len(stack))
                stack.append(k)

    def _below(self, flags: np.ndarray) -> np.ndarray:
        """Which elements are flagged or lie in such."""
        out = flags.copy()
        for k in range(1, len(out)):  # parents come first
            out[k] |= out[self.parent[k]]
        return out

    def _above(self, flags: np.ndarray) -> np.ndarray:
        """Which elements hold flagged ones."""
        out = np.zeros(len(flags), bool)
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] |= out[k] | flags[k]
        return out

    def marks(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Which elements are no text anywhere, which are named as no part of an article, and the roots of articles."""
        n = len(self.tag)
        never, named, inside = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        roots: dict[str, list[int]] = {"article": [], "main": []}
        for k in range(1, n):
            p, tag, attrs = self.parent[k], self.tag[k], self.attrs[k]
            main = tag == "main" or "main" in attrs and re.search(r"role\s*=\s*[\"']?main\b", attrs, re.IGNORECASE) is not None
            inside[k] = inside[p] or tag == "article"
            never[k] = never[p] or tag in MARKUP or bool(attrs and _HIDDEN.search(attrs))
            named[k] = named[p] or (not main and _named_out(tag, attrs, bool(inside[p]))) or (tag == "header" and not inside[p])
            if not (never[k] or named[k]) and (tag == "article" or main):
                kind = "article" if tag == "article" else "main"
                if not inside[p] or kind == "main":
                    roots[kind].append(k)
        return never, named, roots["article"] or roots["main"]

    def subtrees(self, host: str, roots: list[int]) -> tuple[dict[int, int], dict[int, int]]:
        """Hashes of content and of shape of what may be a template; host and subtree decide them.

        Content: blocks, and other elements that have a line of the page to themselves; inside an article boxes only.
        Shape: sections, elements with a class, id or role, and lists of links, none inside an article.
        """
        n = len(self.tag)
        flags = np.zeros(n, bool)
        flags[roots] = True
        inside = self._below(flags)
        flags |= np.array([t in KEEP_WHOLE for t in self.tag])
        holds = self._above(flags) | flags
        salt = xxhash.xxh64_intdigest(host.encode("utf-8", "replace"))
        content, shape = [b""] * n, [b""] * n
        linked, loose = np.zeros(n, bool), np.zeros(n, bool)  # has links; has text outside links
        contents, shapes, alone, whole = {}, {}, self._alone(), np.zeros(n, bool)
        for k in range(n - 1, 0, -1):  # children before their parents
            tag, attrs = self.tag[k], self.attrs[k]
            said, kinds, words = [], {}, False
            for part in self.parts[k]:
                if isinstance(part, int):
                    said.append(content[part])
                    kinds[shape[part]] = None
                    linked[k] |= linked[part]
                    loose[k] |= loose[part]
                elif t := self.source[part[0] : part[1]].split():
                    said.append(" ".join(t).encode("utf-8", "replace"))
                    words = True
            linked[k] |= tag == "a"
            loose[k] = (loose[k] or words) and tag != "a"
            names = sorted(w for w in set(_words(attrs)) if not w.isdigit())
            content[k] = xxhash.xxh64_digest(b"\0".join([tag.encode(), " ".join(attrs.split()).encode("utf-8", "replace"), *said]), salt)
            shape[k] = xxhash.xxh64_digest(b"\1".join([tag.encode(), " ".join(names).encode(), b"w" if words else b"", *kinds]), salt)
            if holds[k]:
                continue
            if self._box(k, bool(names)) if inside[k] else tag in BLOCKS or k in alone:
                contents[k] = int.from_bytes(content[k], "big", signed=True)
            links = tag in LISTS and linked[k] and not loose[k]
            if not inside[k] and (tag in SECTIONS or names or links):
                shapes[k] = int.from_bytes(shape[k], "big", signed=True)
                whole[k] = links or tag in WHOLE
        under = self._below(whole)  # a menu goes as a whole or not at all: its items needn't be counted
        return tuple({k: h for k, h in some.items() if not under[self.parent[k]]} for some in (contents, shapes))

    def _box(self, k: int, named: bool) -> bool:
        return self.tag[k] in BOXES or named and self.tag[k] in NAMED_BOXES

    def _alone(self) -> set[int]:
        """Elements other than blocks that have all the text between two breaks to themselves."""
        out, line = set(), set()
        tops = list(range(len(self.tag)))  # the outermost element of a line that an element lies in; 0 for blocks
        for k in range(1, len(tops)):
            tops[k] = 0 if self.tag[k] in BREAKS else tops[self.parent[k]] or k
        for k, a, b in [*self.flow, (0, -1, -1)]:
            if a < 0:
                if len(line) == 1:
                    out |= line
                line = set()
            elif not self.source[a:b].isspace():
                line.add(tops[k])
        return out - {0}

    def _core(self, out: np.ndarray) -> list[int]:
        """Of a page without an article: the smallest holder of nearly all text that isn't out. None if that is the page."""
        size = np.zeros(len(self.tag), np.int64)
        for k, a, b in self.flow:
            if a >= 0 and not out[k]:
                size[k] += len(self.source[a:b].strip())
        for k in range(len(size) - 1, 0, -1):
            size[self.parent[k]] += size[k]
        k, least = 0, max(1, CORE * size[0])
        while best := [c for c in self.parts[k] if isinstance(c, int) and size[c] >= least and self.tag[c] in HOLDERS]:
            k = best[0]
        return [k] if k and self.tag[k] not in KEEP_WHOLE else []

    def read(self, templates: Callable[[np.ndarray], np.ndarray] | None = None, host: str = "", names: bool = True) -> tuple[str, int]:
        """The text, and how many subtrees were deleted as templates."""
        never, named, roots = self.marks()
        out, n = never.copy(), 0
        if templates is not None:
            contents, shapes = self.subtrees(host, roots)
            own = [*contents.items(), *shapes.items()]
            hits = templates(np.array([h for _, h in own], np.int64)) if own else []
            same = [k for (k, _), hit in zip(own[: len(contents)], hits, strict=False) if hit]
            alike = [k for (k, _), hit in zip(own[len(contents) :], hits[len(contents) :], strict=True) if hit]
            flags = np.zeros(len(out), bool)
            flags[same] = True
            core = roots or self._core(self._below(never | flags))
            mine = np.zeros(len(out), bool)
            mine[core] = True
            inside, around = self._below(mine), self._above(mine)
            boxed = np.array([not inside[k] or self._box(k, bool(_words(self.attrs[k]))) for k in same], bool)
            gone = np.zeros(len(out), bool)
            gone[np.array(same, np.int64)[boxed]] = True
            if core:  # what looks like the core may be another part of it
                like = {(self.tag[k], self.attrs[k]) for k in core}
                gone[[k for k in alike if not (inside[k] or around[k]) and (self.tag[k], self.attrs[k]) not in like]] = True
            gone &= ~around
            whole = self._below(gone | never)
            n = sum(1 for k in np.flatnonzero(gone).tolist() if not whole[self.parent[k]])
            out |= gone
        keep = np.zeros(len(out), bool)
        keep[roots if names and roots else [0]] = True
        out, keep = self._below(out | named if names else out), self._below(keep)
        blocks, now = [], []
        for k, a, b in self.flow:
            if a >= 0:
                if keep[k] and not out[k]:
                    now.append(self.source[a:b])
            elif now:
                blocks.append(now)
                now = []
        blocks.append(now)
        return "\n".join(t for t in (" ".join("".join(map(entities.unescape, b)).split()) for b in blocks) if t), n

    def text(self) -> str:
        """By names alone."""
        return self.read()[0]


def host_of(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _trees(page: Page, host: str) -> list[int]:
    contents, shapes = page.subtrees(host, page.marks()[2])
    return sorted({*contents.values(), *shapes.values()})


def _parts(batch: pa.RecordBatch) -> list[pa.Array]:
    """Hashes of the subtrees of each page, and of its text: copies of a page don't make a template."""
    trees, texts = [], []
    for source, host in zip(batch.column("_html").to_pylist(), batch.column("_host").to_pylist(), strict=True):
        page = Page(source or "")
        trees.append(_trees(page, host))
        texts.append(xxhash.xxh64_intdigest(page.text().encode("utf-8", "replace")) - (1 << 63))
    return [pa.array(trees, pa.list_(pa.int64())), pa.array(texts, pa.int64())]


def templates(pages: DataFrame) -> DataFrame:
    """``tree``, the hashes of the subtrees that are templates of their host, from columns ``_html`` and ``_host``.

    A hash tells the host as well. Equal pairs of hash and text are merged before they are counted, so no host is ever
    one group.
    """
    parts = append(pages.select("_html", "_host"), {"trees": "array<bigint>", "body": "bigint"}, _parts, "_html", BLOCK, ("_html", "_host"))
    seen = cut(parts).select("body", F.explode("trees").alias("tree")).distinct().groupBy("tree").agg(F.count("*").alias("on"))
    return seen.filter(F.col("on") >= LEAST_PAGES).select("tree")


def _among(trees: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which are in a sorted array; np.isin would go through all of it for each page."""
    return np.searchsorted(ordered, trees, "right") > np.searchsorted(ordered, trees, "left")


def main_text(pages: DataFrame, url: str = "url", html: str = "html", into: str = "text", most_broadcast: int = MOST_BROADCAST, names: bool = True, deleted: str | None = None) -> DataFrame:
    """Replaces ``html`` by the main text of the page, ``into``: its blocks in order, joined by line ends.

    ``names=False`` leaves it to templates alone what goes, ``deleted`` is a column for the number of subtrees that
    went as templates. Null html is empty, and an empty page has an empty text; null urls are one host. Pages are read
    whole, whatever their length, broken or cut off as they may be. Repeated rows get the same text; an empty table
    stays empty; other columns stay, unless one is named as an added one.
    """
    spark = pages.sparkSession
    rest = [c for c in pages.columns if c not in (html, into, deleted)]
    source, host, found_in, page = fresh(pages, "_html", "_host", "_trees", "_page")
    pages = pages.select(*rest, F.col(html).alias(source), host_of(url).alias(host))
    plain = lambda *more: pages.select(F.col(source).alias("_html"), F.col(host).alias("_host"), *more)
    found = cut(templates(plain()))
    some = found.limit(most_broadcast + 1).toArrow().column("tree").to_numpy()
    if len(some) <= most_broadcast:
        shared = spark.sparkContext.broadcast(np.sort(some))
        known = lambda trees, _: _among(trees, shared.value)
    else:
        work = lambda batch: [pa.array([_trees(Page(s or ""), h) for s, h in zip(batch.column("_html").to_pylist(), batch.column("_host").to_pylist(), strict=True)], pa.list_(pa.int64()))]
        own = F.xxhash64(host, source)
        has = append(plain(own.alias("_page")), {"trees": "array<bigint>"}, work, "_html", BLOCK, ("_html", "_host")).select("_page", F.explode("trees").alias("tree")).distinct()
        has = has.join(found, "tree").groupBy("_page").agg(F.collect_list("tree").alias(found_in)).withColumnRenamed("_page", page)
        pages = pages.withColumn(page, own).join(has, page, "left").drop(page)
        known = lambda trees, own: np.isin(trees, own or [])

    def extract(batch: pa.RecordBatch) -> list[pa.Array]:
        own = batch.column(found_in).to_pylist() if found_in in batch.schema.names else [None] * batch.num_rows
        rows = zip(batch.column(source).to_pylist(), batch.column(host).to_pylist(), own, strict=True)
        texts, n = [], []
        for s, h, o in rows:
            t, k = Page(s or "").read(lambda trees, o=o: known(trees, o), h, names)
            texts.append(t)
            n.append(k)
        return [pa.array(texts, pa.string()), *([pa.array(n, pa.int64())] if deleted else [])]

    return append(pages, {into: "string"} | ({deleted: "bigint"} if deleted else {}), extract, source, BLOCK, (source, host, found_in))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages, deleted="n_templates").withColumn("n_chars", F.length("text").cast("bigint"))


QUERIES = {"op9_html_extraction": op9_html_extraction}
ORACLE_SQL: dict[str, str] = {}
