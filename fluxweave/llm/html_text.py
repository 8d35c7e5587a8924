"""HTML extraction with site template removal.

A tolerant one-pass parser keeps a stack of open block elements and hashes every element subtree bottom-up (tags and
text), menus, forms and adverts included.  Spark counts each (host, subtree) once a page; subtrees on at least
``min_pages`` pages and ``min_share`` of their host's pages are template and are deleted in a second scan, inside the
article and outside it.  What does not recur but names its role goes after that; all other text stays.  ``n_template``
and ``n_role`` say how many elements went for either reason.  Inside an <article>, paragraphs, headings and table parts
are never template, nor is an element that holds most of the article's text, so that copies of an article, or paragraphs
that many articles share, stay.

Roles: a tag (nav, aside, footer, script ..), a role attribute or being hidden decides outright.  A class or id counts
where the name as a whole says the role (``site-menu`` does, ``has-sidebar`` and ``no-menu`` do not), and a form counts,
but neither removes the page's content: where every article (or main element) that has text stands in such elements, the
largest is freed (not from adverts, consent or reader comments); within it, or on a page without any, so is the largest
such element where what would stay is under a quarter of it.  Inside an article, ``alert`` and ``notice`` are no roles.

Scale: counts are combined map-side; templates are few by construction (each takes ``min_share`` of its host's pages)
and reach the pages by a join on the host that is broadcast under ``broadcast_rows`` and otherwise left to AQE.

Defined results: null html gives the empty text; null urls share the empty host; unclosed and stray tags are tolerated;
an unclosed comment, script or tag runs to the end.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?
    |<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<close2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs2>[^>]*+)(?:>|\Z)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
#: Elements by the HTML standard, and the role words that templates use.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
SILENT = INLINE | {"script", "style", "template", "noscript"}  # no block of their own
DROPPED = frozenset("script style noscript template iframe object embed svg canvas math button select option textarea input label nav aside footer head title menu dialog audio video map datalist".split())
FORMS = frozenset({"form", "fieldset"})
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ROLE_WORDS = frozenset(
    "sponsor sponsored promo promotion banner popup modal overlay newsletter subscribe "
    "signup menu nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets related recommended share sharing social footer masthead toolbar pagination pager skip copyright".split()
)
NOTICE_WORDS = frozenset("alert alerts notice notices".split())
FOREIGN_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense cookie cookies consent gdpr comment comments disqus reply replies respond feedback".split())
#: Words that leave a role as it is where they stand beside its name.
PLACE_WORDS = frozenset(
    "site page main primary secondary global local top bottom left right upper lower inner outer box bar area block section wrapper wrap container content list item items unit slot "
    "module panel region zone group row col column reader readers user users visitor visitors post article blog footer header links link buttons button text form thread".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote td th tr figcaption".split())


class Node:
    __slots__ = ("child_hashes", "content", "digest", "dropped", "end", "in_article", "named", "own", "parent", "raw", "size", "start", "tag")

    def __init__(self, tag: str, parent: Node | None, start: int, named: int, content: int):
        self.tag, self.parent, self.start, self.end, self.named, self.content = tag, parent, start, start, named, content
        self.child_hashes, self.own, self.raw, self.size, self.digest = [], 0, 0, 0, 0
        self.dropped = bool(named or (parent and parent.dropped))
        self.in_article = bool(parent and (parent.in_article or parent.content == 3))


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(raw)}


#: How firmly an element is named: by a class or as a form, as what is never content (adverts, consent, reader comments),
#: by tag, role or being hidden; 0 where it isn't.
SOFT, FOREIGN, HARD = 1, 2, 3


@lru_cache(maxsize=65536)
def _name_role(name: str, in_article: bool, paragraph: bool) -> int:
    """What one class or id says: all its words name a role or a place, and at least one a role."""
    words = [w for w in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w and not w.isdigit()]
    roles = ROLE_WORDS if in_article else ROLE_WORDS | NOTICE_WORDS
    if not in_article and not paragraph:
        roles = roles | {"header"}
    if not all(w in roles | NOTICE_WORDS | FOREIGN_WORDS | PLACE_WORDS for w in words):
        return 0
    return FOREIGN if any(w in FOREIGN_WORDS for w in words) else SOFT if any(w in roles for w in words) else 0


def _role(tag: str, raw: str, in_article: bool) -> tuple[int, int]:
    """(how firmly it is named, how strongly it claims to be the content: 3 an article, 2 the main element)"""
    content = {"article": 3, "main": 2}.get(tag, 0)
    named = SOFT if tag in FORMS else HARD if tag in DROPPED or (tag == "header" and not in_article) else 0
    if raw and ("=" in raw or "hidden" in raw):
        at = _attributes(raw)
        role = at.get("role", "").lower()
        if tag not in ("html", "body"):
            if "hidden" in at or at.get("aria-hidden") == "true" or (role in ROLES and role != "form") or re.search(r"display\s*:\s*none", at.get("style", "").lower()):
                named = HARD
            else:
                names = f"{at.get('class', '')} {at.get('id', '')}".split()
                named = max([named, SOFT if role == "form" else 0, *(_name_role(x, in_article, tag in PARAGRAPHS) for x in names)])
        if not content:
            content = 3 if role == "article" else 2 if role == "main" else 0
    return named, content


class Page:
    """The pieces of text of a page and its elements, each with the range of pieces it holds."""

    def __init__(self, source: str):
        self.pieces: list[str] = []
        self.nodes: list[Node] = []
        self.root = self.top = Node("#root", None, 0, 0, 0)
        at, end = 0, len(source)
        while (m := TOKEN.search(source, at)) is not None:
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m["cdata"] is not None:
                self._text(m["cdata"])
                continue
            tag = (m["tag"] or m["tag2"] or "").lower()
            if not tag:
                continue
            if m["close"] or m["close2"]:
                self._close(tag)
                continue
            raw = m["attrs"] or m["attrs2"] or ""
            self._open(tag, raw)
            if tag in RAW and not raw.endswith("/"):
                stop = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = stop.end() if stop else end
                self._close(tag)
        if at < end:
            self._text(source[at:])
        while self.top is not self.root:
            self._pop()
        self.root.end = len(self.pieces)
        self._settle()

    def _text(self, s: str) -> None:
        s = entities.unescape(s) if "&" in s else s
        self.pieces.append(s)
        n = len(s) - s.count(" ")
        if n and not s.isspace():
            self.top.own += n
            self.top.child_hashes.append(" ".join(s.split()))

    def _open(self, tag: str, raw: str) -> None:
        if tag in CLOSES_P:
            self._close_to({"p"}, {"button", "td", "th", "li", "div", "article", "section", "body", "blockquote"})
        if tag in SIBLINGS:
            self._close_to(SIBLINGS[tag], LIMITS[tag])
        if tag in ("br", "hr"):
            self.pieces.append(" ")
        if tag in VOID:
            return
        inside = self.top.in_article or self.top.content == 3
        named, content = _role(tag, raw, inside)
        if tag in INLINE and not named:
            return
        if tag not in SILENT:
            self.pieces.append(" ")
        self.top = Node(tag, self.top, len(self.pieces), named, content)
        if raw.endswith("/") and tag in ("svg", "path"):
            self._pop()

    def _pop(self) -> None:
        n, up = self.top, self.top.parent
        n.end = len(self.pieces)
        n.digest = xxhash.xxh64_intdigest("\x00".join([n.tag, *n.child_hashes])) - 2**63
        if n.dropped and not up.dropped:  # what names its role is no part of what stands around it
            up.child_hashes.append(f"<{n.tag}>")
        else:
            up.child_hashes.append(f"{n.digest:x}")
        n.child_hashes = []
        self.nodes.append(n)
        self.top = up
        if n.tag not in SILENT:
            self.pieces.append(" ")

    def _close(self, tag: str) -> None:
        n = self.top
        while n is not self.root and n.tag != tag:
            if tag in INLINE and n.tag not in INLINE:  # an inline end tag closes nothing outside its block
                return
            n = n.parent
        if n is self.root:
            return
        while self.top is not n:
            self._pop()
        self._pop()

    def _close_to(self, tags: set[str], limits: set[str]) -> None:
        n, found = self.top, None
        while n is not self.root and n.tag not in limits:
            if n.tag in tags:
                found = n
                break
            n = n.parent
        if found:
            while self.top is not found:
                self._pop()
            self._pop()

    def _measure(self) -> None:
        """What is dropped, by parents first, and each element's text without and (``raw``) with what names a role softly."""
        every = [*self.nodes, self.root]
        for n in reversed(every):
            n.dropped = bool(n.named or (n.parent and n.parent.dropped))
        for n in every:
            n.size = n.raw = n.own
        for n in self.nodes:  # children come before their parents
            if n.named != HARD:
                n.parent.raw += n.raw
            if not n.dropped or n.parent.dropped:
                n.parent.size += n.size

    def _settle(self) -> None:
        """Sizes, and the content freed from elements that name a role softly where all of it stands in such."""
        self._measure()
        if not any(n.named in (SOFT, FOREIGN) for n in self.nodes):
            return
        firm: dict[Node, int] = {self.root: 0}
        for n in reversed(self.nodes):
            firm[n] = max(n.named, firm[n.parent])
        claims = [n for n in self.nodes if n.content and n.raw and firm[n] != HARD]
        if any(n.size and not n.dropped for n in claims):
            return
        best = max((n for n in claims if firm[n] <= SOFT), key=lambda n: (n.content, n.raw), default=None)
        if best:
            self._free(best)
        around = best or (None if claims else self.root)
        if around and 4 * around.size < around.raw:  # all but a little of it stands in one more such element
            within = (n for n in self.nodes if n.named == SOFT and not n.parent.dropped and around.start <= n.start and n.end <= around.end)
            inner = max(within, key=lambda n: n.raw, default=None)
            if inner and 4 * around.size < inner.raw:
                self._free(inner)

    def _free(self, n: Node | None) -> None:
        while n is not None:
            n.named, n = 0, n.parent
        self._measure()

    def articles(self) -> list[Node]:
        """The outermost articles, or else the outermost main elements, in page order; nothing is kept or deleted for being
        outside them."""
        for claim in (3, 2):
            found = []
            for n in sorted((n for n in self.nodes if n.content == claim and n.size and not n.dropped), key=lambda n: (n.start, -n.end)):
                if not found or n.start >= found[-1].end:
                    found.append(n)
            if found:
                return found
        return []

    def removable(self) -> Iterator[Node]:
        """Elements that may be template: any with text but those that hold an article; in an article (or a page without
        one) none with most of its text, and in an article no paragraphs, unless their role is named."""
        articles = self.articles()
        starts, above = [a.start for a in articles], set()
        for n in articles:
            while n is not None:
                above.add(n)
                n = n.parent
        for n in self.nodes:
            if not n.size or n.tag in ("html", "body") or n in above:
                continue
            if n.dropped:
                yield n
                continue
            i = bisect_right(starts, n.start) - 1
            within = articles[i] if i >= 0 and n.end <= articles[i].end else None
            if within and within.content == 3 and n.tag in PARAGRAPHS:
                continue
            around = within or (None if articles else self.root)
            if around and 2 * n.size > around.size:
                continue
            yield n

    def cuts(self, templates: frozenset | set) -> tuple[list[Node], list[Node]]:
        """The outermost elements that recur, and then the other ones that name their role."""
        cut = [n for n in self.removable() if n.digest in templates] if templates else []
        outer, end = [], -1
        for n in sorted(cut, key=lambda n: (n.start, -n.end)):
            if n.end > end:
                outer.append(n)
                end = n.end
        starts = [n.start for n in outer]
        inside = lambda n: (i := bisect_right(starts, n.start) - 1) >= 0 and n.end <= outer[i].end
        return outer, [n for n in self.nodes if n.dropped and not n.parent.dropped and n.size and not inside(n)]

    def text(self, templates: frozenset | set) -> str:
        cut = [(n.start, n.end) for part in self.cuts(templates) for n in part]
        out, at = [], 0
        for a, b in sorted(cut):
            if a > at:
                out += self.pieces[at:a]
            out.append(" ")
            at = max(at, b)
        out += self.pieces[at:]
        return " ".join("".join(out).split())


def _host(url):
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.lower(raw)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 4, min_share: float = 0.1,
            broadcast_rows: int = 200_000) -> DataFrame:
    """id, url, text, n_chars, n_template and n_role of every page."""
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), _host(F.col(url_col)).alias("_host"))

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, digests = [], []
            for host, source in zip(batch.column("_host").to_pylist(), batch.column("_html").to_pylist(), strict=True):
                page = Page(source or "")
                own = {n.digest for n in page.removable()}
                digests += own
                hosts += [host] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.int64())], ["_host", "digest"])

    per_host = rows.groupBy("_host").agg(F.count("*").alias("_n"))
    seen = rows.select("_host", "_html").transform(map_arrow, subtrees, "_host string, digest long").groupBy("_host", "digest").agg(F.count("*").alias("_c")).where(F.col("_c") >= min_pages)
    found = materialize(seen.join(per_host, "_host").where(F.col("_c") >= min_share * F.col("_n")).select("_host", "digest"))
    few = found.count() <= broadcast_rows
    templates = found.groupBy("_host").agg(F.collect_list("digest").alias("_cut"))
    met = rows.join(F.broadcast(templates) if few else templates, "_host", "left").select("_id", "_url", "_html", "_cut")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, gone = [], []
            for source, cut in zip(batch.column("_html").to_pylist(), batch.column("_cut").to_pylist(), strict=True):
                page, templates = Page(source or ""), frozenset(cut or ())
                out.append(page.text(templates))
                gone.append([len(part) for part in page.cuts(templates)])
            count = lambda k: pa.array([g[k] for g in gone], pa.int64())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), count(0), count(1)], ["_id", "_url", "text", "n_chars", "n_template", "n_role"])

    kind = pages.schema[id_col].dataType.simpleString()
    return met.transform(map_arrow, texts, f"_id {kind}, _url string, text string, n_chars long, n_template long, n_role long").withColumnsRenamed({"_id": id_col, "_url": url_col})
