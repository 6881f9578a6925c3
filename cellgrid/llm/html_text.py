"""Main text of web pages, with the templates of their sites removed.

Pages are parsed leniently into elements, once. Element subtrees are hashed
bottom up and counted for each host over pages with different main texts, so
copies of one page count once; a subtree that many pages of its host share is a
template. What remains of the article after templates and page furniture are
deleted is its text. Paragraphs, headings and unmarked lists inside an article
are never counted: prose that several pages quote stays. Its other unmarked
containers, and everything in a page without an article, are loose: near copies
of a page share them too, so they must recur on a larger share of the host.

The parse leaves the blocks of the main text and, for each subtree that may be
a template, the range of blocks that goes with it; counting, looking up and
deleting are joins and array functions over those rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

#: A template stands on at least so many different pages of its host, and on this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.01
#: On so many pages it is one whatever its share, so the size of a host hides none.
ENOUGH_PAGES = 100
#: Loose subtrees need so many times the share and the pages that are enough.
LOOSE = 10
#: The subtrees of one host are dealt to so many groups where its count of pages meets them.
SALTS = 32
#: Without an article, a container whose text stands in links to this share is a menu.
MENU_LINKS = 0.8
#: Elements nest so deep; what goes deeper stands beside, as in browsers.
MAX_DEPTH = 512

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S | re.I)
_VALUE = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead blockquote pre figcaption".split())
_LISTS = frozenset("ul ol dl menu dir".split())
_CLOSES_P = _BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
#: An element closes open ones of these kinds, up to the nearest of the scope.
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_FURNITURE = frozenset("nav footer aside form button select input datalist fieldset dialog menu object canvas video audio map head".split())
#: Words of class, id and role values that mark furniture.
_MARKS = frozenset(
    "nav navbar navigation menu menubar sidebar side aside footer foot masthead topbar breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification alert banner ad ads advert adverts advertisement advertising sponsor sponsored promo promotion popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations teaser comment comments commentlist disqus discussion reply replies respond widget pagination pager toolbar skip search tags complementary contentinfo search form".split()
)
#: Words that stand beside a mark in a compound name (``site-footer``, ``comment-list``) without making it a subject.
_BESIDE = frozenset(
    "area bar block body bottom box btn button buttons col column content container desktop div fixed global group head header home icon icons inner item items js label layout left link links list lists main mobile more outer page panel post posts article articles primary region right row secondary section site slot small stories sub top trigger unit user view widget widgets wide wrap wrapper".split()
)
#: Marks that also name subjects; a block so named stays if it is long prose with few links and holds no comments.
_AMBIGUOUS = frozenset("side alert notice notices search form menu discussion reply replies respond skip tags related share social recommended teaser promotion".split())
#: Characters of text outside links from which a block is long prose, and the greatest share of links in it.
PROSE_CHARS, PROSE_LINKS = 200, 0.25
_HEADS = frozenset({"header", "head", "heading"})
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of what readers write.
_TALK = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Kinds whose ids name their subject.
_NAMED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: A section's id marks furniture if it has a mark and nothing but these beside; its subject may be one of the last.
_AROUND = frozenset("area block box list links post posts article articles section wrap wrapper container content main more stories".split())
_SUBJECTS = frozenset("discussion reply notice notices form social search heading head promotion menu".split())


class Page:
    """Elements and texts of a page in order; an element spans tokens ``first`` to ``last``."""

    def __init__(self, source: str) -> None:
        self.tags: list[str] = []
        self.attrs: list[str] = []
        self.up: list[int] = []
        self.first: list[int] = []
        self.last: list[int] = []
        #: Text, or an element's number, negative (less one) where it ends.
        self.tokens: list[str | int] = []
        stack: list[int] = []
        at = 0

        def close(depth: int) -> None:
            while len(stack) > depth:
                n = stack.pop()
                self.last[n] = len(self.tokens)
                self.tokens.append(-n - 1)

        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self.tokens.append(source[at : m.start()])
            at = m.end()
            name = m[3] or m[6]
            if not name:
                continue
            name, ends, attrs = name.lower(), m[2] or m[5], m[4] or m[7] or ""
            if m[6] and at == len(source) and not source.endswith(">"):
                continue  # cut off inside a tag
            if ends:
                for depth in range(len(stack) - 1, -1, -1):
                    if self.tags[stack[depth]] == name:
                        close(depth)
                        break
                    if name not in _BLOCK and self.tags[stack[depth]] in _BLOCK:
                        break  # an inline end tag doesn't close blocks
                continue
            if name in _CLOSES_P:
                self._shut(stack, {"p"}, {"div", "section", "article", "td", "th", "li", "blockquote", "body", "main", "table"}, close)
            if name in _IMPLIED:
                self._shut(stack, *_IMPLIED[name], close)
            if len(stack) >= MAX_DEPTH:
                close(MAX_DEPTH - 1)
            n = len(self.tags)
            self.tags.append(name)
            self.attrs.append(attrs)
            self.up.append(stack[-1] if stack else -1)
            self.first.append(len(self.tokens))
            self.last.append(len(self.tokens))
            self.tokens.append(n)
            if name in _VOID or attrs.endswith("/") and name not in _BLOCK:
                self.tokens.append(-n - 1)
                self.last[n] = len(self.tokens) - 1
            else:
                stack.append(n)
        if at < len(source):
            self.tokens.append(source[at:])
        close(0)
        self._measure()

    def _shut(self, stack: list[int], kinds: set[str], scope: set[str], close) -> None:
        for depth in range(len(stack) - 1, -1, -1):
            tag = self.tags[stack[depth]]
            if tag in kinds:
                close(depth)
                return
            if tag in scope:
                return

    def _measure(self) -> None:
        """Asides, and for each element its characters: all, outside asides, in links; and its headings."""
        total, linked, heads, links = [0], [0], [0], 0
        for t in self.tokens:
            size, head = (len(t), 0) if isinstance(t, str) else (0, 0)
            if not isinstance(t, str):
                links += (1 if t >= 0 else -1) * (self.tags[t if t >= 0 else -t - 1] == "a")
                head = t >= 0 and self.tags[t] in _HEADINGS
            total.append(total[-1] + size)
            linked.append(linked[-1] + (size if links > 0 else 0))
            heads.append(heads[-1] + head)
        self._sums = {"all": total, "links": linked, "heads": heads}
        self.aside = [False] * len(self.tags)
        for n, tag in enumerate(self.tags):
            up = self.up[n]
            own = tag in ("nav", "footer", "aside", "form")
            if not own and self.attrs[n]:
                own = not self.classes(n).isdisjoint(_MARKS) if tag == "article" else tag not in ("html", "body", "main") and self.marked(n)
            self.aside[n] = own or (up >= 0 and self.aside[up])
        plain, now = [0], -1
        for t in self.tokens:
            if not isinstance(t, str):
                now = t if t >= 0 else self.up[-t - 1]
            plain.append(plain[-1] + (len(t) if isinstance(t, str) and not (now >= 0 and self.aside[now]) else 0))
        self._sums["plain"] = plain

    def size(self, n: int, what: str = "all") -> int:
        sums = self._sums[what]
        return sums[self.last[n]] - sums[self.first[n]]

    def linked(self, n: int) -> bool:
        """At least half of the text stands in links."""
        return 2 * self.size(n, "links") >= self.size(n) > 0

    def menu(self, n: int) -> bool:
        """A container that is nothing but links, or a short list of them."""
        tag = self.tags[n]
        return tag in _BLOCK and tag not in _PROSE and tag not in ("body", "html", "main", "article") and self.size(n) > 0 and self.size(n, "links") >= MENU_LINKS * self.size(n)

    def values(self, n: int) -> dict[str, str]:
        return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _VALUE.finditer(self.attrs[n])}

    def classes(self, n: int) -> set[str]:
        """Whole class names."""
        return set(self.values(n).get("class", "").split()) if self.attrs[n] else set()

    def marks(self, n: int) -> set[str]:
        """Furniture that class, role and id name: whole names, and compounds of nothing but marks and layout words.

        So ``site-footer`` is a footer and ``side-effects`` is a subject. An id that names a subject counts for nothing.
        """
        if not self.attrs[n]:
            return set()
        values = self.values(n)
        names = lambda k: {x for name in values.get(k, "").split() if (x := _named(name))}
        out, own = names("class") | names("role"), names("id")
        words = {w for w in re.split(r"[^a-z0-9]+", values.get("id", "")) if w}
        if self.tags[n] in _NAMED or (self.tags[n] == "section" and (words <= _SUBJECTS or not words <= _MARKS | _AROUND)):
            return out
        return out | own

    def marked(self, n: int) -> bool:
        own = self.marks(n) & _MARKS
        return bool(own) and not (own <= _AMBIGUOUS and self.prose(n))

    def prose(self, n: int) -> bool:
        """Long text in paragraphs, few links, and nothing inside that is named as a comment, a reply or a form."""
        size = self.size(n)
        if size - self.size(n, "links") < PROSE_CHARS or self.size(n, "links") > PROSE_LINKS * size:
            return False
        inside = range(n + 1, self._after(n))
        return any(self.tags[i] == "p" for i in inside) and not any(self.tags[i] in ("form", "input", "textarea", "nav") or self.marks(i) & _TALK for i in inside)

    def _after(self, n: int) -> int:
        """The first element after ``n`` and all inside it."""
        return bisect_left(self.first, self.last[n])

    def named(self, n: int) -> set[str]:
        """Words of class, role and id."""
        values = self.values(n) if self.attrs[n] else {}
        return {w for k in ("class", "role", "id") for w in re.split(r"[^a-z0-9]+", values.get(k, "")) if w}

    def main(self) -> list[int]:
        """The article: the fullest ``article`` outside furniture and those beside it, or the ``main`` around if that says more.

        Else what is marked as content, else ``body``; empty: all of the page.
        """
        plain = lambda n: self.size(n, "plain")
        kinds = lambda kind: [n for n, t in enumerate(self.tags) if t == kind and not self.aside[n]]
        articles, within = [], -1
        for n in kinds("article"):
            if self.first[n] > within:
                articles.append(n)
                within = self.last[n]
        if mains := kinds("main"):
            most = max(mains, key=plain)
            if 2 * sum(plain(n) for n in articles if self.first[most] < self.first[n] < self.last[most]) < plain(most):
                return [most]
        if articles:
            most = max(articles, key=plain)
            return [n for n in articles if n == most or (self.up[n] == self.up[most] and not self.linked(n))]
        found = [n for n in range(len(self.tags)) if self.attrs[n] and not self.aside[n] and self.tags[n] in ("div", "section") and self.named(n) & {"main", "article", "content", "post", "entry", "story"}]
        if found:
            return [max(found, key=plain)]
        return [n for n, t in enumerate(self.tags) if t == "body"][:1]

    def furniture(self, n: int) -> bool:
        """An element inside the main one that is deleted for what it is."""
        tag = self.tags[n]
        if tag in _FURNITURE:
            return True
        if tag == "header":
            return not self.size(n, "heads")
        if not self.attrs[n]:
            return False
        unseen = bool(_HIDDEN.search(_QUOTED.sub("", self.attrs[n])) or _UNSEEN.search(self.attrs[n]))
        return unseen or self.marked(n) or (not self.marks(n).isdisjoint(_HEADS) and not self.size(n, "heads") and tag not in _HEADINGS and not self.prose(n))

    def blocks(self, main: list[int]) -> tuple[list[str], dict[int, tuple[int, int]]]:
        """Texts of the main elements by block, white space as one blank, and the blocks of each block element inside."""
        out: list[str] = []
        now: list[str] = []
        begin: dict[int, int] = {}
        spans: dict[int, tuple[int, int]] = {}

        def end() -> None:
            if now:
                if clean := _SPACE.sub(" ", html.unescape("".join(now))).strip():
                    out.append(clean)
                now.clear()

        whole = not any(self.tags[n] != "body" for n in main)  # no article: containers of links are menus
        for i, stop in [(self.first[n] + 1, self.last[n]) for n in main] or [(0, len(self.tokens))]:
            while i < stop:
                t = self.tokens[i]
                if isinstance(t, str):
                    now.append(t)
                else:
                    n = t if t >= 0 else -t - 1
                    block = self.tags[n] in _BLOCK
                    if block:
                        end()
                    if t < 0:
                        if block:
                            spans[n] = (begin[n], len(out))
                    elif self.furniture(n) or (whole and self.menu(n)):
                        i = self.last[n]
                    elif block:
                        begin[n] = len(out)
                    elif self.tags[n] == "br":
                        now.append(" ")
                i += 1
            end()
        return out, spans

    def digests(self) -> list[int]:
        """Hash of each element's names and texts, of those inside it as well."""
        out, stack = [0] * len(self.tags), [[]]
        for t in self.tokens:
            if isinstance(t, str):
                stack[-1].append(_SPACE.sub(" ", t))
            elif t >= 0:
                stack.append([self.tags[t]])
            else:
                out[-t - 1] = xxhash.xxh3_64_intdigest("\0".join(stack.pop()))
                stack[-1].append(f"\1{out[-t - 1]}")
        return out

    def subtrees(self, main: list[int], spans: dict[int, tuple[int, int]]) -> list[tuple[int, bool, int, int]]:
        """Hash, looseness and blocks of each element with text that may be a template.

        In a page without an article all blocks count. In an article no prose
        does; of the rest all but lists count, and lists that carry attributes
        of their own or are mostly links.
        """
        article = any(self.tags[n] != "body" for n in main)
        digests, out = self.digests(), []
        for n, (a, b) in spans.items():
            tag = self.tags[n]
            if a == b or tag in ("html", "body") or (article and tag in _PROSE):
                continue
            loose = tag in _PROSE or not (self.attrs[n].strip() or self.linked(n))
            if not (loose and article and tag in _LISTS):
                out.append((digests[n], loose, a, b))
        return out


@lru_cache(1 << 16)
def _named(name: str) -> str | None:
    """The mark or heading word that a whole class name stands for."""
    words = [w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()]
    found = [w for w in words if w in _MARKS or w in _HEADS]
    return found[0] if found and all(w in _MARKS or w in _HEADS or w in _BESIDE for w in words) else None


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _hash(text: str) -> int:
    x = xxhash.xxh3_64_intdigest(text)
    return x - (1 << 64) if x >= 1 << 63 else x


def parsed(pages: DataFrame) -> DataFrame:
    """``(page, host, own, blocks, subtrees, id)``: other columns, hashes of host and main text, the text's blocks, what may be a template.

    ``id`` is unique, its upper bits number the partition that parsed the page.
    """
    others = [c for c in pages.columns if c not in ("html", "text")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("page"), "url", "html")
    kind = T.StructType([rows.schema["page"], *T._parse_datatype_string("host long, own long, blocks array<string>, subtrees array<struct<key:long,loose:boolean,a:int,b:int>>").fields])
    subtree = pa.list_(pa.struct([("key", pa.int64()), ("loose", pa.bool_()), ("a", pa.int32()), ("b", pa.int32())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hosts, own, blocks, trees = [], [], [], []
            for url, source in zip(part.column("url").to_pylist(), part.column("html"), strict=True):
                page, host = Page(source.as_py() or ""), host_of(url)
                main = page.main()
                texts, spans = page.blocks(main)
                hosts.append(_hash(host))
                own.append(_hash("\n".join(texts)))
                blocks.append(texts)
                trees.append([{"key": _hash(f"{host}\0{digest}\0{int(loose)}"), "loose": loose, "a": a, "b": b} for digest, loose, a, b in page.subtrees(main, spans)])
            yield pa.RecordBatch.from_arrays([part.column("page"), pa.array(hosts, pa.int64()), pa.array(own, pa.int64()), pa.array(blocks, pa.list_(pa.string())), pa.array(trees, subtree)], ["page", "host", "own", "blocks", "subtrees"])

    return rows.mapInArrow(run, kind).withColumn("id", F.monotonically_increasing_id())


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, enough: int = ENOUGH_PAGES) -> DataFrame:
    """``(key)`` of the subtrees of ``parsed`` pages that recur on enough different pages of their host."""
    seen = pages.select("host", "own", F.explode("subtrees").alias("s")).select("host", "own", "s.key", "s.loose").distinct()
    counts = seen.groupBy("host", "key", "loose").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    hosts = pages.select("host", "own").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    hosts = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    least = F.least(min_share * F.col("pages"), F.lit(float(enough))) * F.when(F.col("loose"), LOOSE).otherwise(1)
    both = counts.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(hosts, ["host", "salt"])
    return both.filter(F.col("n") >= least).select("key")


def main_texts(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, enough: int = ENOUGH_PAGES) -> DataFrame:
    """The columns of ``pages(url, html, ...)`` but ``html``, with ``text``: the main text of each row's whole page.

    A null ``html`` is empty and gives an empty text; a null ``url`` is the host
    without a name. Repeated rows give equal rows, other columns stay (one named
    ``text`` is replaced), an empty table gives an empty result.
    """
    rows = stored(parsed(pages), "parsed-pages")
    found = rows.select("id", F.shiftright("id", 33).alias("part"), F.explode("subtrees").alias("s")).select("id", "part", "s.key", "s.a", "s.b")
    # Each partition asks once for each key, so one that a third of all pages hold meets its template in few rows.
    asked = found.select("key", "part").distinct().join(templates(rows, min_pages, min_share, enough).hint("merge"), "key")
    ranges = found.join(asked.hint("merge"), ["key", "part"]).groupBy("id").agg(F.sort_array(F.collect_set(F.struct("a", (-F.col("b")).alias("nb")))).alias("r"))
    # The outermost first: a range within those before adds nothing.
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<a:int,b:int>>").alias("kept"))
    add = lambda acc, r: F.struct((-r["nb"]).alias("end"), F.concat(acc["kept"], F.array(F.struct(F.greatest(r["a"], acc["end"]).alias("a"), (-r["nb"]).alias("b")))).alias("kept"))
    outer = F.aggregate("r", none, lambda acc, r: F.when(-r["nb"] <= acc["end"], acc).otherwise(add(acc, r)), lambda acc: acc["kept"])
    gone = ranges.select("id", F.flatten(F.transform(outer, lambda r: F.sequence(r["a"], r["b"] - 1))).alias("gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size("blocks") - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.array_join("blocks", "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.get("blocks", i)), "\n"))
    # Only pages with a subtree that may be a template meet the join.
    some = rows.filter(F.size("subtrees") > 0).join(gone.hint("merge"), "id", "left").select("page", text.alias("text"))
    whole = rows.filter(F.size("subtrees") == 0).select("page", F.array_join("blocks", "\n").alias("text"))
    return some.union(whole).select("page.*", "text")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = main_texts(table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
