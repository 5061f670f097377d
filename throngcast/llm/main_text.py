"""Main text of web pages by template deduction over each host's pages.

The project keeps no web pages, so the operator is general: any table of (page_id, url, html).
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .aliases import host_of
from .common import content, fresh, small_batches, written

#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold main text.
OUTSIDE = frozenset("head nav header footer aside form script style noscript template button select textarea iframe object svg math dialog menu input label option".split())
#: Names in class, id or role that mark what is not main text; a name counts whole, so section-header or header-fixed marks nothing.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion nav navbar navigation menu menus breadcrumb
 breadcrumbs header masthead site-header page-header footer site-footer page-footer sidebar sidebars sidebar-left sidebar-right aside widget widgets notice notices cookie cookies cookie-banner cookie-notice consent gdpr banner banners alert popup modal overlay
 comment comments commentlist comment-list disqus reply replies respond related related-posts recommended recommendations share sharing social newsletter subscribe subscription signup
 login search pagination pager toolbar tagcloud complementary contentinfo skip copyright legal""".split())
#: Elements that hold the page or its text: words of their class, id or role are about layout and mark nothing.
UNMARKED = frozenset("html body main article".split())
#: Elements that a start tag does not close anything beyond.
SCOPES = frozenset("article main section div body html ul ol dl table blockquote".split())
#: A quoted > is no end of a tag; what a possessive group has read it does not try again.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
#: Start tags that end an open paragraph or item.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def chunks(page: str) -> list[tuple[int, str, bool]]:
    """A page's tokens in order: (path, text, article).

    Tags have an empty text; texts are blocks: white space is one space, character references are decoded, and block tags end them. `path`
    is a hash of the enclosing elements with their marks, however deep; `article` tells that one of them is an article or main element. Text inside elements
    that never hold main text is left out and does not break the block around it. Unclosed and crossing tags close at the nearest
    match, text without tags is one block, and whatever follows the last tag counts.
    """
    out: list[tuple[int, str, bool]] = []
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]       # name, path, outside, article
    open_: Counter = Counter()                                               # elements on the stack by name
    said: list[str] = []

    def enter(*element) -> None:
        stack.append(element)
        open_[element[0]] += 1

    def close() -> str:
        name = stack.pop()[0]
        open_[name] -= 1
        return name

    def flush() -> None:
        if said:
            text = _SPACE.sub(" ", references.unescape("".join(said))).strip()
            said.clear()
            if text:
                out.append((stack[-1][1], text, stack[-1][3]))

    at, size = 0, len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        start = token.start() if token else size
        if start > at and not stack[-1][2]:
            said.append(page[at:start])
        if token is None:
            break
        at = token.end()
        name = token.group(2)
        if name is None:
            continue
        name, attributes = name.lower(), token.group(3)
        if token.group(1):
            if open_[name]:
                if name not in INLINE:
                    flush()
                while close() != name:
                    pass
            continue
        if name in RAW:
            if name in ("svg", "math") and attributes.endswith("/"):         # foreign elements may be empty; elsewhere the slash means nothing
                continue
            end = _END[name].search(page, at)
            at = end.end() if end else size
            continue
        marks = ""
        if "=" in attributes:
            marks = " ".join(v for m in _ATTRIBUTE.finditer(attributes) for v in m.groups()[1:] if v).lower()
        _, path, was_outside, article = stack[-1]
        marked = bool(marks) and name not in UNMARKED and not MARKS.isdisjoint(marks.split())
        outside = was_outside or name in OUTSIDE or marked
        if name in VOID:
            if not was_outside:
                said.append("\n")
                if name == "hr":
                    flush()
            continue
        if name in INLINE:
            if outside:                                                      # its end tag has to be told from others
                enter(name, path, True, article)
            continue
        if not was_outside:
            flush()
        ends = CLOSES.get(name, frozenset()) | {"p"}                          # a block ends a paragraph, an item its neighbour
        if any(open_[e] for e in ends):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    while len(stack) > i:
                        close()
                    _, path, was_outside, article = stack[-1]
                    outside = was_outside or name in OUTSIDE or marked
                    break
                if stack[i][0] in SCOPES:
                    break
        path = xxhash.xxh3_64_intdigest(f"{path}/{name}.{marks}")
        article = article or name in ("article", "main")
        enter(name, path, outside, article)
        out.append((path, "", article))
    flush()
    return out


def _key(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\0{text}") - (1 << 63)


def _tokens(pages: pa.Array) -> pa.Array:
    rows = []
    for page in pages.to_pylist():
        counts: dict[int, int] = {}
        for path, text, _ in chunks(page):
            key = _key(path, text)
            counts[key] = counts.get(key, 0) + 1
        rows.append([{"token": k, "uses": n} for k, n in counts.items()])
    return pa.array(rows, pa.list_(pa.struct([("token", pa.int64()), ("uses", pa.int32())])))


def templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = 4, min_share: float = 0.5, min_class: int = 3) -> DataFrame:
    """(host, tokens): the tokens of each host's template, outermost class first.

    A token is a tag or a text block with its path. Tokens of a host with the same occurrence vector over its distinct pages form an
    equivalence class; a vector is stood for by its support, its sum and the sum of a hash of (page, uses), so that classes come
    from pre-aggregated sums and no host is gathered. A class is valid when it has min_class tokens or more and occurs on min_pages pages
    and on min_share of the host's. Classes nest by support: what every page has encloses what fewer pages have.
    Tokens of one page count once however many copies the page has.
    """
    page = small_batches(pages).select(host_of(F.col(url)).alias("host"), content(html).alias("html"))
    seen = page.select("host", F.xxhash64("html").alias("page"), F.explode(F.arrow_udf(_tokens, "array<struct<token:bigint,uses:int>>")("html")).alias("t"))
    seen = written(seen.groupBy("host", "t.token", "page").agg(F.max("t.uses").alias("uses")), "tokens")
    # every page has a token for its outermost tag or text; pages without any have no template to find
    sizes = seen.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("pages"))
    vectors = seen.groupBy("host", "token").agg(F.count("*").alias("support"), F.sum("uses").alias("uses"),
                                                F.sum(F.xxhash64("page", "uses").cast("decimal(20,0)")).cast("string").alias("vector"))
    frequent = written(vectors.where(F.col("support") >= min_pages).join(sizes, "host").where(F.col("support") >= min_share * F.col("pages")), "vectors")
    valid = frequent.groupBy("host", "support", "uses", "vector").agg(F.collect_list("token").alias("tokens")).where(F.size("tokens") >= min_class)
    # a template is one host's own markup: its size is that of a page
    return valid.groupBy("host").agg(F.array_sort(F.collect_list(F.struct(F.negate("support").alias("order"), "tokens"))).alias("c")) \
        .select("host", F.flatten(F.transform("c", lambda c: c["tokens"])).alias("tokens"))


def main_blocks(page: str, template: set[int]) -> list[str]:
    """Text blocks in page order whose token the template lacks; without a template, those of articles when the page has any."""
    found = chunks(page)
    left = [(text, article) for path, text, article in found if text and _key(path, text) not in template]
    inside = [] if template else [text for text, article in left if article]
    return inside or [text for text, _ in left]


def _extract(pages: pa.Array, tokens: pa.Array) -> pa.Array:
    return pa.array(["\n\n".join(main_blocks(page, set(t or ()))) for page, t in zip(pages.to_pylist(), tokens.to_pylist())], pa.string())


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html", salts: int = 16, **template) -> DataFrame:
    """Pages with `text`, the main text of the whole html (a column of that name is replaced); every row and column stays.

    Elements that never hold main text (by tag, or by words in class, id or role of any but UNMARKED elements) are skipped; so are text blocks that belong to
    the template of the page's host, inside articles too. On hosts without a template, text outside a page's articles is skipped. Blocks are joined by two \\n. NULL and empty pages give an empty text; a NULL url has the empty
    host; copies and repeated rows give equal results; a host with few pages has no template and loses nothing to it.

    Templates join back on (host, salt), repeated for each salt, so that the pages of a large host meet in many tasks.
    """
    host, salt, tokens = (fresh(pages, s) for s in ("host", "salt", "tokens"))
    known = written(templates(pages, url, html, **template).select(F.col("host").alias(host), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(salt), F.col("tokens").alias(tokens)), "templates")
    keyed = pages.withColumns({host: host_of(F.col(url)), salt: F.pmod(F.xxhash64(content(html)), F.lit(salts)).cast("int")})
    joined = keyed.join(known, [host, salt], "left")
    return joined.withColumn("text", F.arrow_udf(_extract, "string")(content(html), F.col(tokens))).drop(host, salt, tokens)
