"""Main text of web pages by site template removal.

Element subtrees of every page are hashed bottom-up (tag and text, without
attributes), counted per host in Spark, and subtrees that recur across many
pages of their host are deleted before the text is joined, inside the content
as well; pages with equal text are one page. Inside an article element a
subtree must recur on more pages than elsewhere. What the page itself marks
decides the rest: text inside its article (or main) element is the content;
elements whose tag, role, class or id names boilerplate are deleted, but for
content elements in them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm.common import map_batches, materialize

# A subtree is template if it stands on so many distinct pages of its host,
# and on such a share of them.
MIN_PAGES = 3
MIN_SHARE = 0.3
# The same inside an article element, whose author may repeat a passage.
ARTICLE_PAGES = 10
ARTICLE_SHARE = 0.5

# Elements nested deeper are flattened into their parent.
MAX_DEPTH = 150

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg math object canvas select xmp noembed noframes title".split())
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
section summary table tbody td tfoot th thead title tr ul""".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form head menu dialog button input label fieldset".split())
# Elements beside the content by definition: a content root in one counts only
# if the page has no other.
BESIDE_TAGS = frozenset("nav footer aside menu dialog".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Of the raw elements, those whose content is markup: without an end tag they
# end at once.
RAW_MARKUP = frozenset("svg math object canvas template noscript select".split())
# An opening tag closes an open element of these kinds (optional end tags).
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}}
P_ENDS = frozenset("""address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr main menu nav ol p pre section table ul""".split())
# Words of a class or id that name boilerplate.
BOILERPLATE_WORD = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|promotion|"
    r"nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side-bar|footer|masthead|site-header|page-header|topbar|"
    r"cookie|cookies|consent|notice|gdpr|popup|modal|newsletter|subscribe|subscription|share|sharing|social|"
    r"comment|comments|disqus|reply|replies|respond|related|recommended|widget|toolbar|pagination|pager|skip-link)(?=$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|"
                    r"<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)>", re.S)
# One attribute: its name, and its value with or without quotes.
_ATTR = re.compile(r"([^\s/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")


# Kinds of content roots.
MAIN, ARTICLE = 1, 2


class _Element:
    __slots__ = ("tag", "parts", "boiler", "root", "has", "hash")

    def __init__(self, tag: str, boiler: bool, root: int):
        self.tag, self.boiler, self.root = tag, boiler, root
        self.parts: list = []  # text (str) and children (_Element), in order
        self.has = False  # is or holds a content root
        self.hash = 0


def _marks(tag: str, attrs: str, inside_root: bool) -> tuple[bool, int]:
    """(boilerplate, kind of content root or 0) as the element itself says."""
    boiler = tag in BOILERPLATE_TAGS or (tag == "header" and not inside_root)
    root = {"article": ARTICLE, "main": MAIN}.get(tag, 0)
    if attrs:
        given: dict[str, str] = {}
        for m in _ATTR.finditer(attrs):
            given.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        role = given.get("role", "").strip().lower()
        root = root or {"article": ARTICLE, "main": MAIN}.get(role, 0)
        boiler = boiler and not root or role in BOILERPLATE_ROLES
        for name in ("class", "id"):
            boiler = boiler or (not root and tag not in ("html", "body") and bool(BOILERPLATE_WORD.search(given.get(name, ""))))
        boiler = (boiler or "hidden" in given or given.get("aria-hidden", "").lower() == "true"
                  or bool(re.search(r"display\s*:\s*none", given.get("style", ""), re.I)))
    return boiler, 0 if boiler else root


def parse(source: str | None) -> _Element:
    """Element tree of a page; broken markup never fails."""
    top = _Element("html", False, 0)
    stack, pos, roots = [top], 0, 0
    source = source or ""
    n = len(source)
    scan = _TOKEN.search
    while pos < n:
        m = scan(source, pos)
        if m is None:
            stack[-1].parts.append(source[pos:])
            break
        if m.start() > pos:
            stack[-1].parts.append(source[pos:m.start()])
        pos = m.end()
        if not m[2]:
            if source.startswith("<![CDATA[", m.start()):
                stack[-1].parts.append(html.escape(source[m.start() + 9:pos].removesuffix("]]>"), quote=False))
            continue
        tag = m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    roots -= sum(e.root > 0 for e in stack[depth:])
                    del stack[depth:]
                    break
                if stack[depth].tag in ("article", "main", "body") and tag not in ("html", "body"):
                    break
            continue
        if tag in RAW:
            closed = m[3].endswith("/")
            if closed and tag in RAW_MARKUP:
                continue
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, pos)
            if end:
                pos = end.end()
            elif not closed and tag not in RAW_MARKUP:
                pos = n
            continue
        if tag in P_ENDS or tag in CLOSED_BY:
            closes = CLOSED_BY.get(tag, ()) if tag not in P_ENDS else ("p",)
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in closes:
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCK:
                    break
        boiler, root = _marks(tag, m[3], roots > 0)
        element = _Element(tag, boiler, root)
        if len(stack) <= MAX_DEPTH or (root and not roots) or (boiler and not any(e.boiler for e in stack)):
            stack[-1].parts.append(element)
        else:  # its text stays, as its parent's
            element.root = root = 0
            element.parts = stack[-1].parts
            element.parts.append(" ")
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(element)
            roots += root > 0
    _settle(top)
    return top


def _settle(top: _Element) -> None:
    """Decide which content roots count, and mark the elements around them."""
    roots: tuple[list[_Element], list[_Element]] = [], []

    def find(e: _Element, beside: bool) -> None:
        beside = beside or e.tag in BESIDE_TAGS
        if e.root:
            roots[beside].append(e)
        for part in e.parts:
            if not isinstance(part, str):
                find(part, beside)

    def mark(e: _Element) -> bool:
        below = [mark(p) for p in e.parts if not isinstance(p, str)]
        e.has = e.root > 0 or any(below)
        return e.has

    find(top, False)
    if roots[0]:
        for e in roots[1]:
            e.root = 0
    if roots[0] or roots[1]:
        mark(top)
    find = mark = None  # functions that name themselves are cycles: free them now


def subtree_hashes(top: _Element) -> list[int]:
    """Hash of every block subtree that is not left out anyway, bottom-up;
    each element keeps its hash, which is odd inside an article. Elements
    without text have none, nor have those that hold content: they are never
    deleted."""
    found: list[int] = []

    def walk(e: _Element, article: bool) -> bytes:
        if e.boiler and not e.has:
            return b""
        article = article or e.root == ARTICLE
        digest = blake2b(e.tag.encode("utf-8", "replace"), digest_size=8)
        empty = True
        for part in e.parts:
            if isinstance(part, str):
                text = part.strip()
                if text:
                    empty = False
                    digest.update(b"\0" + text.encode("utf-8", "replace"))
            else:
                sub = walk(part, article)
                if sub:
                    empty = False
                    digest.update(b"\1" + sub)
        if empty:
            return b""
        out = digest.digest()
        if e.tag in BLOCK and e.tag not in ("html", "body") and not e.has:
            e.hash = int.from_bytes(out, "big", signed=True) & ~1 | article
            found.append(e.hash)
        return out

    walk(top, False)
    walk = None  # a function that names itself is a cycle: free it now
    return found


def blocks(top: _Element) -> list[tuple[str, list[int]]]:
    """Text blocks in page order as (text, hashes of the subtrees around it
    that a template may delete). If the page marks content, only that, whatever
    stands around it; boilerplate-marked elements are left out."""
    out: list[tuple[str, list[int]]] = []
    buffer: list[str] = []
    marked = top.has

    def flush(path: list[int]) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
        buffer.clear()
        if text:
            out.append((text, list(path)))

    def walk(e: _Element, inside: bool, path: list[int]) -> None:
        if e.boiler:
            flush(path)
            if not e.has:
                return
            inside = False
        elif e.root:
            flush(path)
            inside, path = True, []
        block = e.tag in BLOCK
        here = path
        if block:
            flush(path)
            here = path + [e.hash] if e.hash else path
        for part in e.parts:
            if isinstance(part, str):
                if inside or not marked:
                    buffer.append(part)
            else:
                walk(part, inside, here)
        if block:
            flush(here)

    walk(top, False, [])
    flush([])
    walk = None
    return out


def content_key(found: list[tuple[str, list[int]]]) -> int | None:
    """Digest of a page's text before templates go (no text: none)."""
    if not found:
        return None
    text = "\n".join(text for text, _ in found)
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def host_of(url):
    """Host of a url column in lower case (null or none: empty)."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def page_subtrees(pages: DataFrame) -> DataFrame:
    """(host, content, subtree): the distinct subtree hashes of each page with
    text, and a null for the page itself. Pages of one host with equal text
    have the same content key."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hosts, keys, hashes = [], [], []
        for host, source in zip(*(c.to_pylist() for c in batch.columns)):
            top = parse(source)
            subtrees = {None, *subtree_hashes(top)}
            key = content_key(blocks(top))
            if key is not None:
                hosts += [host] * len(subtrees)
                keys += [key] * len(subtrees)
                hashes += subtrees
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()),
                                          pa.array(hashes, pa.int64())], ["host", "content", "subtree"])

    return map_batches(pages.select("host", "html"), run, "host string, content long, subtree long")


def templates(subtrees: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, subtree) standing on at least ``min_pages`` distinct pages and
    ``min_share`` of the distinct pages of the host; inside articles on at
    least ARTICLE_PAGES and ARTICLE_SHARE, if those are more."""
    article = F.col("subtree").bitwiseAND(F.lit(1)) == 1
    pages = F.when(article, F.lit(max(min_pages, ARTICLE_PAGES))).otherwise(F.lit(min_pages))
    share = F.when(article, F.lit(max(min_share, ARTICLE_SHARE))).otherwise(F.lit(min_share))
    hosts = materialize(subtrees.where("subtree is null").groupBy("host").agg(F.count_distinct("content").alias("pages")), "html-hosts")
    seen = (subtrees.where("subtree is not null").groupBy("host", "subtree").agg(F.count_distinct("content").alias("n"))
            .where(F.col("n") >= pages))
    return seen.join(hosts, "host").where(F.col("n") >= share * F.col("pages")).select("host", "subtree")


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``.

    Null html is an empty page with empty text; pages without a host share
    the host ''; pages of a host with equal text count as one page; extra
    columns are ignored; empty input gives no rows. No text is cut.
    """
    from pyspark.sql import types as T

    keyed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    subtrees = materialize(page_subtrees(keyed), "html-subtrees")
    template = materialize(templates(subtrees, min_pages, min_share), "html-templates")
    doomed = materialize(subtrees.join(template, ["host", "subtree"]).select("host", "content", "subtree"), "html-doomed")
    doomed = doomed.groupBy("host", "content").agg(F.collect_set("subtree").alias("doomed"))

    # Blocks travel compressed; deleting needs no second parse.
    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        keys, packed = [], []
        for source in batch.column(3).to_pylist():
            top = parse(source)
            subtree_hashes(top)
            found = blocks(top)
            keys.append(content_key(found))
            packed.append(squeeze.compress("\n".join(
                f"{','.join(map(str, path))}\t{text}" for text, path in found).encode("utf-8", "replace")))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.int64()), pa.array(packed, pa.binary())],
                                         ["page_id", "url", "host", "content", "packed"])

    id_type, url_type = pages.schema["page_id"].dataType, pages.schema["url"].dataType
    packed_schema = T.StructType([T.StructField("page_id", id_type), T.StructField("url", url_type),
                                  T.StructField("host", T.StringType()), T.StructField("content", T.LongType()),
                                  T.StructField("packed", T.BinaryType())])
    packed = map_batches(keyed.select("page_id", "url", "host", "html"), pack, packed_schema)

    def unpack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor()
        texts = []
        for blob, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            gone = set(gone or ())
            kept = []
            for line in loose.decompress(blob).decode("utf-8").split("\n"):
                path, _, text = line.partition("\t")
                if text and not (gone and path and gone.intersection(map(int, path.split(",")))):
                    kept.append(text)
            texts.append(" ".join(kept))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()),
                                          pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    # Few, sorted hashes per page; the packed blocks are the wide side.
    joined = packed.join(doomed, ["host", "content"], "left").select("page_id", "url", "packed", "doomed")
    return map_batches(joined, unpack, T.StructType([
        T.StructField("page_id", id_type), T.StructField("url", url_type),
        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
