"""Main text of web pages: site templates found by counting element subtrees per host, then page rules.

A subtree that stands on many differing pages of a host is template, wherever it is. What templates do not show,
elements named for another purpose, is dropped by tag, role and class; the article is what is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm.common import column, rows_out, slices, table
from riskflow.session import freeze

#: A subtree is template from this many differing pages of its host or of a section (first folder) of it, and this share of them.
MIN_PAGES = 5
MIN_SHARE = 0.5
#: Own text of an element from this many characters on is a paragraph, whatever its tag.
PARAGRAPH = 80
#: So many (host, subtree) pairs, 8 bytes each, are broadcast; more are joined to the pages by host.
BROADCAST_TEMPLATES = 2_000_000

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.S)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br "
             "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mtable mtr mtd mspace semantics".split())
CLOSED_BY_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CELLS = ("td", "th", "table")
TABLE_PARTS = set("tr tbody thead tfoot table".split())
LIST_ROOTS = set("ul ol dl table select".split())
DROPPED = set("head script style nav footer aside form noscript template button select textarea iframe svg canvas object audio video dialog menu title noembed noframes".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words in class or id that name what is not the article.
OTHER = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|adbox|adslot|sponsor\w*|promo\w*|banner\w*|sidebar\w*|side|menu\w*|nav|navbar\w*|navigation\w*|breadcrumb\w*|footer\w*|foot|"
    r"topbar|cookie\w*|consent\w*|gdpr|notice\w*|alerts?|popup\w*|modal\w*|overlay\w*|newsletter\w*|subscri\w*|signup|login|paywall|social\w*|share\w*|sharing|related\w*|recommend\w*|"
    r"comments?|commentlist|disqus\w*|respond|repl(?:y|ies)|pagination|pager|toolbar|widget\w*|search\w*|copyright|disclaimer|skip|outbrain|taboola|hidden)(?:$|[^a-z])")
READERS = re.compile(r"(?:^|[^a-z])(?:comments?|commentlist|disqus\w*|respond|repl(?:y|ies))(?:$|[^a-z])")
HEADER = re.compile(r"(?:^|[^a-z])(?:header|masthead|head)(?:$|[^a-z])")
LAYOUT = re.compile(r"(?<=\s)(?:has|with|without|no|show|hide|enable|js|is)[-_]\S+")
CONTENT = re.compile(r"(?:^|[^a-z])(?:article|articlebody|post|entry|story|content|maintext|main|text|body)(?:$|[^a-z])")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attrs", "items", "hash", "main", "size", "core")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.items, self.hash, self.main = tag, attrs, [], 0, tag in ("article", "main")
        self.size = self.core = 0  # characters below; those of the largest element below that is named as content


def parse(html: str) -> Node:
    """The element tree; text is kept raw. Missing end tags are supplied where HTML has it so."""
    root = Node("#root", "")
    open_ = [root]
    places: dict[str, list[int]] = {}  # of the open elements, by tag
    solid: list[int] = []  # places of open elements that end the search for an open paragraph
    at, find = 0, TOKEN.search

    def last(tag: str) -> int:
        found = places.get(tag)
        return found[-1] if found else 0

    def cut(i: int) -> None:
        while len(open_) > i:
            places[open_.pop().tag].pop()
        while solid and solid[-1] >= i:
            solid.pop()

    while True:
        m = find(html, at)
        if m is None:
            break
        if m.start() > at:
            open_[-1].items.append(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            i = last(tag)
            if i and (tag in TABLE_PARTS or i >= max(map(last, CELLS))):
                cut(i)
            continue
        if tag not in INLINE and (i := last("p")) and i > (solid[-1] if solid else 0):
            cut(i)
        if tag in CLOSED_BY_SELF and (i := max(map(last, CLOSED_BY_SELF[tag]))) > max(map(last, LIST_ROOTS)):
            cut(i)
        node = Node(tag, m[3] or m[6] or "")
        open_[-1].items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            node.items.append(html[at : end.start() if end else len(html)])
            at = end.end() if end else len(html)
        elif tag not in VOID and not node.attrs.endswith("/"):
            places.setdefault(tag, []).append(len(open_))
            if tag not in INLINE and tag != "p":
                solid.append(len(open_))
            open_.append(node)
    if at < len(html):
        open_[-1].items.append(html[at:])
    return root


def settle(node: Node) -> None:
    """Give each element the hash of its subtree (tags and texts), its size, and what it holds of an article; children first, without recursion."""
    order, todo = [], [node]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [x for x in n.items if type(x) is Node]
    for n in reversed(order):
        h = xxhash.xxh64(n.tag)
        for x in n.items:
            if type(x) is Node:
                h.update(x.hash.to_bytes(8, "little"))
                n.main |= x.main
                n.size += x.size
                n.core = max(n.core, x.core)
            elif not x.isspace():
                n.size += len(x)
                h.update(b"\x00" + " ".join(x.split()).encode("utf-8", "surrogatepass"))
        n.hash = h.intdigest()
        if n.tag in DROPPED:
            n.size = n.core = 0
        elif n.tag in ("article", "main") or (n.attrs and n.tag in ("div", "section", "td") and is_content(n.attrs)):
            n.core = max(n.core, n.size)


@lru_cache(maxsize=4096)
def _names(attrs: str) -> tuple[str, dict[str, str]]:
    """Class and id in lower case, without words on layout such as has-sidebar, and all attributes."""
    found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attrs)} if attrs.strip() else {}
    return LAYOUT.sub(" ", CAMEL.sub("-", f" {found.get('class', '')} {found.get('id', '')}").lower()), found


@lru_cache(maxsize=4096)
def is_content(attrs: str) -> bool:
    names, found = _names(attrs)
    return found.get("itemprop") == "articleBody" or bool(CONTENT.search(names) and not OTHER.search(names) and not HEADER.search(names))


def dropped(node: Node, inside: bool, half: float) -> bool:
    """Whether an element is not part of an article, by what it says of itself; ``inside``: within an article.

    Its names don't count if content of more than ``half`` a page stands in it: then they tell of the page's layout.
    """
    if node.tag in DROPPED:
        return True
    if node.tag == "header" and not inside and not node.main:
        return True
    if not node.attrs or node.tag in ("html", "body"):
        return False
    names, found = _names(node.attrs)
    if "hidden" in found or found.get("aria-hidden") == "true" or UNSEEN.search(found.get("style", "")):
        return True
    if node.tag != "article" and (node.main or (node.core > half and not READERS.search(names))):
        return False
    return found.get("role", "").lower() in ROLES or bool(OTHER.search(names)) or (not inside and bool(HEADER.search(names)))


def blocks(node: Node, templates, half: float, contents: dict[int, bool]) -> list[str]:
    """The texts of the blocks below ``node`` in page order, without dropped elements and templates.

    ``contents``: by id the content elements, with whether headers below belong to the article.
    """
    out, now = [], []

    def close() -> None:
        if now:
            text = " ".join(unescape("".join(now)).split())
            if text:
                out.append(text)
            now.clear()

    todo: list = [(node, False)]
    while todo:
        x, inside = todo.pop()
        if x is None:
            close()
        elif type(x) is str:
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        elif x is node or not (dropped(x, inside, half) or (x.hash in templates and x.tag not in INLINE and not (x.main or x.tag in ("html", "body")))):
            if x.tag not in INLINE:
                close()
                todo.append((None, inside))
            inside = contents.get(id(x), inside)
            todo += [(below, inside) for below in reversed(x.items)]
    close()
    return out


class Survey:
    """What a page holds, outermost first: content elements, elements around paragraphs outside of those, and the parent of each element met."""

    def __init__(self, root: Node, templates):
        self.half = root.size / 2
        self.contents: list[tuple[Node, bool]] = []
        self.holders: list[Node] = []
        self.above: dict[int, Node | None] = {}
        self.body, self.declared = root, []
        todo: list[tuple[Node, Node | None]] = [(root, None)]
        while todo:
            n, parent = todo.pop()
            self.above[id(n)] = parent
            if n.tag == "body":
                self.body = n
            attrs = _names(n.attrs)[1] if n.attrs else {}
            if n.tag == "main" or attrs.get("role") == "main":
                self.declared.append(n)
            if n.tag in ("article", "main") or attrs.get("role") == "main":
                self.contents.append((n, True))
                continue
            if n.tag in ("div", "section", "td") and is_content(n.attrs):
                # around an article, the header of such an element is the page's
                self.contents.append((n, not n.main))
                continue
            if n.tag == "p" and parent is not None and n.size:
                self.holders.append(parent)
            elif n.tag not in INLINE and n.tag not in RAW and sum(len(x.strip()) for x in n.items if type(x) is str) >= PARAGRAPH:
                self.holders.append(n)
            below = [x for x in n.items if type(x) is Node and not dropped(x, False, self.half) and not (x.hash in templates and not x.main and x.tag not in ("html", "body"))]
            todo += [(x, n) for x in reversed(below)]

    def around(self, nodes: list[Node]) -> Node:
        """The smallest element around all of ``nodes``; each element is walked once."""
        path, n = [], nodes[0]
        while n is not None:
            path.append(n)
            n = self.above[id(n)]
        at, cut, walked = {id(x): i for i, x in enumerate(path)}, 0, set()
        for n in nodes:
            while id(n) not in at and id(n) not in walked:
                walked.add(id(n))
                n = self.above[id(n)]
            cut = max(cut, at.get(id(n), 0))
        return path[cut]


def core(root: Node) -> list[str]:
    """The blocks of the longest content element of a page, or what surrounds its paragraphs: what tells its article from others, without what stands around it."""
    s = Survey(root, ())
    texts = [blocks(n, (), s.half, {id(n): inside}) for n, inside in s.contents]
    best = max(texts, key=lambda t: sum(map(len, t)), default=[])
    return best or blocks(s.around(s.holders) if s.holders else s.body, (), s.half, {}) or blocks(s.body, (), s.half, {})


def article(root: Node, templates=frozenset()) -> str:
    """The article of a page, in page order.

    A page that declares its main element has its text there. On others it is all text in the smallest element around the outermost articles, the elements
    named as content, and the paragraphs outside of those, but for what templates and names drop.
    """
    s = Survey(root, templates)
    marked = {id(n): inside for n, inside in s.contents}
    if any(blocks(n, templates, s.half, marked) for n in s.declared):
        return "\n".join(x for n, _ in s.contents for x in blocks(n, templates, s.half, marked))
    nodes = [n for n, _ in s.contents if n.size] + s.holders
    found = blocks(s.around(nodes), templates, s.half, marked) if nodes else []
    return "\n".join(found or blocks(s.body, templates, s.half, marked))


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def section_of(url: str | None) -> str:
    """Host and first folder of an address; empty if it names no folder."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*/+([^/?#]+)/", url or "")
    return f"{host_of(url)}/{m[1]}" if m else ""


def pair_hash(host: str, subtree: int) -> int:
    return xxhash.xxh64_intdigest(subtree.to_bytes(8, "little") + host.encode("utf-8", "surrogatepass")) - (1 << 63)


SUBTREES = pa.schema([("host", pa.string()), ("subtree", pa.int64()), ("page", pa.int64())])


def subtrees(pages: DataFrame) -> DataFrame:
    """``host, subtree, page``: each block element's hash with the hash of its page's article, and one row with subtree 0 a page.

    Every page counts for its host and, if its address has a folder, for that section too, whose name stands as ``host``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            out = set()
            for url, html in zip(column(batch, "url"), column(batch, "html")):
                sites, root = {host_of(url), section_of(url) or host_of(url)}, parse(html or "")
                settle(root)
                page = xxhash.xxh64_intdigest("\n".join(core(root)).encode("utf-8", "surrogatepass")) - (1 << 63)
                out.update((site, 0, page) for site in sites)
                todo = [root]
                while todo:
                    n = todo.pop()
                    below = [x for x in n.items if type(x) is Node]
                    todo += below
                    if n.tag not in INLINE and n.tag not in ("#root", "html", "body", "head") and n.tag not in VOID:
                        out.update((site, pair_hash(site, n.hash), page) for site in sites)
            yield rows_out(SUBTREES, zip(*sorted(out)) if out else [[]] * 3)

    return pages.select("url", "html").mapInArrow(work, "host string, subtree long, page long")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, subtree`` of subtrees on at least ``min_pages`` pages and ``min_share`` of the pages of a host or a section.

    Pages with the same article count once, so an article published under many addresses is not a template.
    """
    counted = subtrees(pages).distinct().groupBy("host", "subtree").count()
    counted = freeze(counted.where((F.col("count") >= min_pages) | (F.col("subtree") == 0)))
    sites = counted.where("subtree = 0").select(F.col("host").alias("site"), F.col("count").alias("pages"))
    found = counted.where("subtree <> 0").join(sites, F.col("host") == F.col("site"))
    return found.where(F.col("count") >= F.col("pages") * min_share).select("host", "subtree")


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, limit: int = BROADCAST_TEMPLATES) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id``, ``url``, ``html``; other columns are ignored).

    Character references are decoded, white space within a block is one space, blocks are joined by line feeds. Null and empty html
    give an empty text. Pages without a host (null url too) count as one host. Repeated rows each get a row. An empty
    table gives an empty result.
    """
    found = freeze(templates(pages, min_pages, min_share))
    own = pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html")
    shared = None
    if found.count() <= limit:
        shared = pages.sparkSession.sparkContext.broadcast(np.sort(found.select("subtree").toArrow()["subtree"].to_numpy()))
        own = own.withColumn("templates", F.lit(None).cast("array<long>"))
    else:
        head = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//"
        host = F.coalesce(F.lower(F.regexp_extract("url", head + r"(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
        folder = F.regexp_extract("url", head + r"[^/?#]*/+([^/?#]+)/", 1)
        # the templates of a host or a section are at most the subtrees of two of its pages
        by_site = found.groupBy("host").agg(F.collect_list("subtree").alias("listed"))
        of_host, of_section = (by_site.select(F.col("host").alias(f"_{n}"), F.col("listed").alias(n)) for n in ("of_host", "of_section"))
        own = own.withColumn("site", host).withColumn("section", F.when(folder != "", F.concat("site", F.lit("/"), folder)))
        own = own.join(of_host, F.col("site") == F.col("_of_host"), "left").join(of_section, F.col("section") == F.col("_of_section"), "left")
        none = F.array().cast("array<long>")
        own = own.select("page_id", "url", "html", F.concat(F.coalesce("of_host", none), F.coalesce("of_section", none)).alias("templates"))

    class Known:
        def __init__(self, sites: set[str], hashes: np.ndarray):
            self.sites, self.hashes, self.seen = sites, hashes, {}

        def __contains__(self, subtree: int) -> bool:
            if subtree not in self.seen:
                self.seen[subtree] = any(self.holds(pair_hash(site, subtree)) for site in self.sites)
            return self.seen[subtree]

        def holds(self, h: int) -> bool:
            at = np.searchsorted(self.hashes, h)
            return bool(at < len(self.hashes) and self.hashes[at] == h)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            out = []
            for page_id, url, html, own_templates in zip(*(column(batch, c) for c in ("page_id", "url", "html", "templates"))):
                root = parse(html or "")
                settle(root)
                hashes = shared.value if shared else np.sort(np.array(own_templates or [], dtype=np.int64))
                text = article(root, Known({host_of(url), section_of(url) or host_of(url)}, hashes))
                out.append((page_id, url, text, len(text)))
            yield rows_out(TEXTS, zip(*out) if out else [[]] * 4)

    return own.mapInArrow(work, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
