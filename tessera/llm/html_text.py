"""Main text of HTML pages, with site templates found by counting element subtrees per host.

A page is parsed once into a light tree (implied end tags, raw-text elements and unclosed tags handled as browsers
do where it matters for text). Three things decide what is text:

1. Roles: elements that are boilerplate by their tag, ARIA role, hidden state, or by a class or id that names
   boilerplate as a whole ("cookie-notice", not "notice-period"): menus, headers and footers of the page, sidebars,
   notices, adverts, forms, comments of readers, markup. A paragraph, heading, list item, quote or table cell of an
   article is never taken for its own class, and not with a container whose class may name contents as well ("menu").
2. Site templates: every element's subtree gets a hash of its tags and text; Spark counts on how many distinct
   pages of a host each hash occurs (whole copies of a page count once); subtrees that recur on `MIN_PAGES` pages
   and on `SHARE` of the host's pages or more are deleted. The element that holds the page's article is never
   deleted as a whole, nor are its paragraphs, headings, quotes, list items and table cells, which are what it
   says; they stay where a list, table or section around them is deleted, too.
3. The article: what is left of the top-level `article` elements (else of `main`, else of the body).

If template removal would leave no text at all, the page is one that the host serves often: it keeps its text.
Blocks are joined by one space in page order; inside a block white space (Python's definition) becomes one space.

Counting is by partial aggregates, so a host with a third of all pages costs no more in one task than others.
Pages meet their host's templates by a join on the page; only the hashes of subtrees that recur are sent.

Defined results: null and empty html give an empty text. A null url is a host of its own. page_id is only carried;
rows that are equal in page_id, url and html get equal results, and rows that share a page_id are pages of their own.
Other columns are ignored. A page of the size of megabytes is one Python string; nothing is cut, and the work grows
in proportion to its size, however deep its elements lie.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as H

MIN_PAGES = 10
SHARE = 0.1
SMALL_DELETIONS = 20_000  # up to so many pages with deletions are broadcast (some hundred bytes each)

#: Element names of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
DROPPED = frozenset("head script style noscript iframe template svg math nav footer aside button select textarea dialog menu object embed canvas audio video title noembed noframes xmp label input".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr figcaption caption".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "p": {"button", "td", "th", "table", "article", "body", "section", "div"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip".split())
#: Words of class and id attributes that name boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promoted promotion cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu "
    "menus breadcrumb breadcrumbs sidebar aside widget widgets footer masthead toolbar pagination pager comment comments disqus replies respond reply share sharing social follow subscribe subscription newsletter signup "
    "login search related recommended recommendations teaser teasers skip copyright".split()
)
#: Words that say where such an element stands or what it is made of, and change nothing of that.
NEUTRAL = frozenset(
    "a area article articles bar block blocks bottom box boxes btn button buttons center col column columns container content desktop fixed floating form global group holder icon icons inline inner item items "
    "label left link links list main message messages mobile module outer page panel post posts primary region right row secondary section site slot small sticky story strip text top unit wrap wrapper zone".split()
)

_TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: Those of MARKS that may as well name what an article is about: they take none of its paragraphs away.
VAGUE_WORDS = frozenset("alert aside banner copyright follow login menu menus modal notice notices overlay popup promotion recommendations recommended related search skip teaser teasers widget widgets".split())
#: Those of MARKS that name what readers wrote: never a frame around the whole page.
REPLIES = frozenset("comment comments disqus replies respond reply".split())
HARD, SOFT, REPLY, VAGUE = 3, 1, 2, 4


def boilerplate(tag: str, attrs: str, in_article: bool) -> int:
    """HARD for what a tag, role or hidden state says; SOFT, VAGUE or REPLY for what a form or a class name suggests; else 0."""
    if tag in DROPPED:
        return HARD
    if tag == "header" and not in_article:
        return HARD
    soft = SOFT if tag == "form" else 0
    if not attrs:
        return soft
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return HARD
        if name == "role" and value.lower() in ROLES:
            return HARD
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HARD
        if name in ("class", "id") and tag not in ("html", "body", "main") and not (in_article and tag in TEXTUAL):
            for token in value.split():
                words = {w.lower() for w in _WORDS.findall(token)}
                if not words & MARKS or words - MARKS - NEUTRAL:
                    continue  # "share-price" or "follow-up" name something else
                if words & REPLIES:
                    soft = REPLY
                elif tag != "article" and soft != REPLY:
                    soft = soft or VAGUE if words & MARKS <= VAGUE_WORDS else SOFT
    return soft


class Page:
    """Elements in order of their start: tag, parent, first block, end block, dropped, protected; and the blocks."""

    def __init__(self, html: str):
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.start: list[int] = [0]
        self.end: list[int] = [0]
        self.mark: list[int] = [0]
        self.skipped: list[bool] = [False]  # in a hard-marked element: its text isn't kept
        self.blocks: list[str] = []
        self.owner: list[int] = []
        self._parse(html)
        self.end[0] = len(self.blocks)
        self.dropped = self._drops()
        self._protect()

    def _parse(self, html: str) -> None:
        stack = [0]
        open_tags: Counter[str] = Counter()  # on the stack
        text: list[str] = []
        at = 0

        def flush() -> None:
            if text:
                block = " ".join("".join(text).split())
                text.clear()
                if block:
                    self.blocks.append(block)
                    self.owner.append(stack[-1])

        def close(depth: int) -> None:
            while len(stack) > depth:
                open_tags[self.tag[stack[-1]]] -= 1
                self.end[stack.pop()] = len(self.blocks)

        def find(tags, scope) -> int | None:
            if not any(open_tags[x] for x in tags):
                return None
            for i in range(len(stack) - 1, 0, -1):
                if self.tag[stack[i]] in tags:
                    return i
                if self.tag[stack[i]] in scope:
                    return None
            return None

        n = len(html)
        for m in iter(lambda: _TAG.search(html, at), None):
            if m.start() > at and not self.skipped[stack[-1]]:
                text.append(entities.unescape(html[at : m.start()]))  # no reference goes on behind a tag
            at = m.end()
            name = m[3] or m[6]
            if not name:
                continue
            tag, closing, attrs = name.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
            if tag in INLINE and tag != "a":
                if not closing and attrs and boilerplate(tag, attrs, False) and tag not in VOID:
                    flush()
                elif not closing or find({tag}, ()) is None:
                    continue
            elif tag == "a" and (closing or not attrs or not boilerplate(tag, attrs, False)):
                if not closing or find({"a"}, ()) is None:
                    continue
            if closing:
                scope = () if tag not in ("p", "li") else SCOPES[tag]
                i = find({tag}, scope)
                if i is not None:
                    flush()
                    close(i)
                elif tag in CLOSES_P or tag == "br":
                    flush()
                continue
            flush()
            if tag in VOID:
                continue
            if tag in CLOSES_P and (i := find({"p"}, SCOPES["p"])) is not None:
                close(i)
            if tag in CLOSED_BY and (i := find(CLOSED_BY[tag], SCOPES[tag])) is not None:
                close(i)
            if tag == "body" and (i := find({"head"}, ())) is not None:
                close(i)
            in_article = bool(open_tags["article"] or open_tags["main"])
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.start.append(len(self.blocks))
            self.end.append(len(self.blocks))
            self.mark.append(boilerplate(tag, attrs, in_article))
            self.skipped.append(self.skipped[stack[-1]] or self.mark[-1] == HARD)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
            elif not attrs.endswith("/") or tag in CLOSES_P or tag in ("body", "html"):
                stack.append(node)
                open_tags[tag] += 1
        if at < n and not self.skipped[stack[-1]]:
            text.append(entities.unescape(html[at:]))
        flush()
        close(1)

    def _drops(self) -> list[bool]:
        """Marked elements and what is in them. A soft mark doesn't hold for a frame: an element around all of the
        page's articles, or, where there are none, around four fifths of its text."""
        n = len(self.tag)
        last = [i for i in range(n)]  # the last element inside each one
        for i in range(n - 1, 0, -1):
            last[self.parent[i]] = max(last[self.parent[i]], last[i])
        heads = [i for i in range(1, n) if self.tag[i] in ("article", "main") and not self.skipped[i] and self.mark[i] != REPLY and self.start[i] < self.end[i]]
        size = [0]
        for b in self.blocks:
            size.append(size[-1] + len(b))
        out, vague, within = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            above, held = self.parent[i], self.mark[i]
            within[i] = within[above] or self.tag[i] in ("article", "main")
            if held in (SOFT, VAGUE):
                if heads:
                    frame = i < heads[0] and heads[-1] <= last[i]
                else:
                    frame = size[self.end[i]] - size[self.start[i]] >= 0.8 * size[-1]
                held = 0 if frame else held
            # What an article says is spared where only a vague class name stands around it.
            spared = vague[above] and not held and within[above] and self.tag[i] in TEXTUAL
            out[i] = bool(held) or (out[above] and not spared)
            vague[i] = out[i] and held in (0, VAGUE) and (vague[above] or not out[above])
        return out

    def _protect(self) -> None:
        """The article's elements: top-level ones of article, else main, that aren't dropped; never deleted whole."""
        n = len(self.tag)
        size = [0]  # of the text kept in the blocks before each one
        for block, owner in zip(self.blocks, self.owner, strict=True):
            size.append(size[-1] + (0 if self.dropped[owner] else len(block)))
        length = lambda i: size[self.end[i]] - size[self.start[i]]
        for wanted in ("article", "main"):
            inside = [False] * n
            roots = []
            for i in range(1, n):
                inside[i] = inside[self.parent[i]] or self.tag[i] == wanted
                if self.tag[i] == wanted and not inside[self.parent[i]] and not self.dropped[i]:
                    roots.append(i)
            if any(length(i) for i in roots):
                break
        else:
            inside, roots = [True] * n, []
        self.roots, self.inside = roots, inside
        largest = max(roots, key=length, default=0)
        self.kept = set()
        while largest >= 0:
            self.kept.add(largest)
            largest = self.parent[largest]
        self.in_roots = [not roots] * len(self.blocks)
        for r in roots:
            self.in_roots[self.start[r] : self.end[r]] = [True] * (self.end[r] - self.start[r])

    def hashes(self) -> dict[int, int]:
        """Hash of each element that could be deleted: its tag, its text and the hashes of the elements in it, in order.

        Made from the innermost elements outwards, each once. Elements without text have none.
        """
        parts: list[list[tuple[int, int]]] = [[] for _ in self.tag]  # of each element: (first block, hash)
        for k, (block, owner) in enumerate(zip(self.blocks, self.owner, strict=True)):
            parts[owner].append((k, xxhash.xxh3_64_intdigest(block.encode("utf-8", "surrogatepass"))))
        out = {}
        for i in range(len(self.tag) - 1, 0, -1):
            if not parts[i]:
                continue
            packed = b"".join(h.to_bytes(8, "little") for _, h in sorted(parts[i]))
            h = xxhash.xxh3_64_intdigest(self.tag[i].encode("utf-8", "surrogatepass") + b"\0" + packed)
            parts[i] = []
            parts[self.parent[i]].append((self.start[i], h))
            if i not in self.kept and not (self.dropped[i] and self.dropped[self.parent[i]]) and not self._says(i):
                out[i] = h - (1 << 64) if h >= 1 << 63 else h
        return out

    def _says(self, node: int) -> bool:
        """What the article says: no template takes it."""
        return bool(self.roots) and self.inside[node] and self.tag[node] in TEXTUAL

    def text(self, templates: frozenset[int] = frozenset()) -> str:
        dropped = list(self.dropped)
        if templates:
            names = self.hashes()
            for i in range(1, len(self.tag)):
                dropped[i] = dropped[i] or names.get(i) in templates or (dropped[self.parent[i]] and not self._says(i))
        blocks = [b for k, b in enumerate(self.blocks) if self.in_roots[k] and not dropped[self.owner[k]]]
        if not blocks and templates:
            return self.text()
        return " ".join(blocks)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _subtrees(batches):
    """One row for each host, page and subtree hash; pages as the hash of the row's key, copy as that of the HTML."""
    for batch in batches:
        hosts, pages, copies, names = [], [], [], []
        for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if not html:
                continue
            found = set(Page(html).hashes().values())
            copy = xxhash.xxh3_64_intdigest(html.encode("utf-8", "surrogatepass"))
            hosts += [host_of(url)] * len(found)
            pages += [page] * len(found)
            copies += [copy - (1 << 64) if copy >= 1 << 63 else copy] * len(found)
            names += found
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(copies, pa.int64()), pa.array(names, pa.int64())], names=["host", "page", "copy", "h"])


def _extracted(batches):
    for batch in batches:
        out = []
        for html, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            out.append(Page(html).text(frozenset(gone or ())) if html else "")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def templates(keyed: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page, gone): the subtree hashes to delete from each page that has any. keyed: page, url, html."""
    rows = keyed.select("page", "url", "html").mapInArrow(_subtrees, "host string, page long, copy long, h long")
    rows = H.settle(rows, "html-subtrees")
    size = rows.groupBy("host").agg(F.countDistinct("copy").alias("pages"))
    often = rows.groupBy("host", "h").agg(F.countDistinct("copy").alias("n")).filter(F.col("n") >= min_pages)
    often = often.join(size, "host").filter(F.col("n") >= F.col("pages") * SHARE).select("host", "h")
    return rows.join(often, ["host", "h"]).groupBy("page").agg(F.collect_set("h").alias("gone"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    keyed = H.in_small_batches(pages).select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = keyed.withColumn("page", F.xxhash64("page_id", "url", "html"))
    gone = H.settle(templates(keyed, min_pages), "html-gone")
    n = gone.count()
    if n == 0:
        joined = keyed.withColumn("gone", F.lit(None).cast("array<long>"))
    else:
        joined = keyed.join(F.broadcast(gone) if n <= SMALL_DELETIONS else gone, "page", "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "gone").mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")
