"""HTML extraction by nearest-URL page differencing (operator 9).

A page is cut into blocks of text, each with what its place in the markup says:
inside the article, outside of it, or in a part that is never main text (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments).  The blocks are written once.  Within each host the pages are sorted
by address path, over ranges of the whole table rather than host by host, and
each page is paired with the neighbour whose path shares the longer beginning.
The lines of both, compared by their hashes, are aligned by their longest common
subsequence, and shared lines are deleted where the markup does not place them
inside an article: the frame of a site repeats on its pages, while an article
that two pages share (a copy under a second address) is still main text.  Lines
outside of articles are frame only if the articles hold at least as much text as
those of them that the neighbour does not share.

Defined results: a null or empty page has no text; a page alone on its host, or
one that repeats its neighbour's whole frame and has no article, keeps what the
markup leaves; a null address is host and path ``""``; repeated pages are one
page and get the same text.  Columns of the input stay but for the markup; columns named like an
output are replaced.
"""

from __future__ import annotations

import html as entities
import json
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import OWN, arrow_column, written

# ---- fixed values: elements and names that are never main text ---------------------------
SKIPPED = ["nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "label", "fieldset", "figcaption"]
RAW = ["script", "style", "noscript", "template", "svg", "title", "textarea", "iframe", "object", "annotation", "annotation-xml"]
#: Elements that end where they begin if written so; in HTML itself the sign means nothing.
FOREIGN = ["svg", "math", "annotation", "annotation-xml"]
#: Main text where they stand inside an article.
CAPTIONS = ["figcaption", "label"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
BLOCKS = [
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figure", "h1", "h2", "h3",
    "h4", "h5", "h6", "head", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "ul",
]
NAMES = [
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "footer", "gdpr", "header", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup",
    "promo", "promoted", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
]
#: Of these names only some may apply to an article element itself.
ASIDES = ["ad", "ads", "advert", "advertisement", "comment", "comments", "promo", "promoted", "related", "sponsor", "sponsored"]
NEGATIONS = ["has", "no", "with", "without"]
ROLES = ["banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search"]
# ------------------------------------------------------------------------------------------
CLOSED_BY = {"p": {*BLOCKS, *SKIPPED} - {"body", "html", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
NAMED = re.compile(r"(?i)\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none")
SPACE = re.compile(r"\s+")
SKIP_SET, RAW_SET, VOID_SET, BLOCK_SET, NAME_SET, ROLE_SET, ASIDE_SET = map(frozenset, (SKIPPED, RAW, VOID, [*BLOCKS, *SKIPPED], NAMES, ROLES, ASIDES))
SECTIONING = frozenset(["article", "main", "div", "section", "table", "td", "body", "html", *SKIPPED])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
SKIP, OUTSIDE, ARTICLE = 0, 1, 2


def _unwanted(tag: str, attributes: str) -> bool:
    if tag in SKIP_SET:
        return True
    if not attributes:
        return False
    for name, *values in NAMED.findall(attributes):
        words = "".join(values).lower()
        if name.lower() == "role":
            if words in ROLE_SET:
                return True
        elif tag not in ("html", "body", "main"):
            for one in words.split():
                parts = re.split(r"[_-]+", one)
                if parts[0] not in NEGATIONS and not NAME_SET.isdisjoint(parts) and (tag != "article" or not ASIDE_SET.isdisjoint(parts)):
                    return True
    return bool(HIDDEN.search(attributes))


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, place) of each block in page order; place is ``SKIP``, ``OUTSIDE`` or ``ARTICLE``."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # open elements with the place of their text
    held: list[str] = []
    at = 0

    def place() -> int:
        return stack[-1][1] if stack else OUTSIDE

    def flush() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
        if text:
            out.append((text, place()))
        held.clear()

    while found := TOKEN.search(page, at):
        held.append(page[at : found.start()])
        at = found.end()
        if not (tag := (found[2] or "").lower()):
            continue
        closing = bool(found[1])
        if tag in BLOCK_SET:
            flush()
        if tag in FOREIGN and not closing and found[3].rstrip().endswith("/"):
            continue
        if tag in RAW_SET and not closing:
            end = re.compile(rf"(?i)</{re.escape(tag)}\s*(?:>|\Z)").search(page, at)
            at = end.end() if end else len(page)
        elif tag in VOID_SET:
            held.append(" " if tag == "br" else "")
        elif closing:
            names = [x for x, _ in stack]
            if tag in names:
                cut = len(names) - 1 - names[::-1].index(tag)
                if tag in SECTIONING or not any(x in SECTIONING for x in names[cut + 1 :]):
                    inline = tag not in BLOCK_SET
                    if inline and any(x in BLOCK_SET for x in names[cut + 1 :]):
                        continue  # a stray end of inline markup closes no block
                    if place() != stack[cut - 1][1] if cut else place() != OUTSIDE:
                        flush()
                    del stack[cut:]
        else:
            while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                stack.pop()
            if tag in BLOCK_SET and any(x == "p" for x, _ in stack):
                names = [x for x, _ in stack]
                cut = len(names) - 1 - names[::-1].index("p")
                if tag in CLOSED_BY["p"] and not any(x in BLOCK_SET for x in names[cut + 1 :]):
                    del stack[cut:]
            inherited = place()
            # the header of an article belongs to it
            judged = "span" if tag in CAPTIONS and inherited == ARTICLE else tag
            own = SKIP if inherited == SKIP or _unwanted(judged, found[3]) and not (tag == "header" and inherited == ARTICLE) else ARTICLE if tag in ("article", "main") or inherited == ARTICLE else OUTSIDE
            if own != inherited:
                flush()
            if not found[3].rstrip().endswith("/"):
                stack.append((tag, own))
    held.append(page[at:])
    flush()
    return out


def shared(mine: list, theirs: list) -> set[int]:
    """Places in ``mine`` of a longest common subsequence with ``theirs``; rows of bits, so memory is n*m/8 bytes at most."""
    start = 0
    while start < min(len(mine), len(theirs)) and mine[start] == theirs[start]:
        start += 1
    a, b = len(mine), len(theirs)
    while a > start and b > start and mine[a - 1] == theirs[b - 1]:
        a, b = a - 1, b - 1
    same = {*range(start), *range(a, len(mine))}
    left, right = mine[start:a], theirs[start:b]
    common = set(left) & set(right)
    left_at = [start + i for i, x in enumerate(left) if x in common]
    left, right = [x for x in left if x in common], [x for x in right if x in common]
    masks: dict = {}
    for j, x in enumerate(right):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(right)) - 1
    row, rows = full, [full]
    for x in left:  # a zero bit j: the row's count grows at j
        hit = row & masks[x]
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    i, j = len(left), len(right)
    count = lambda i, j: (~rows[i] & ((1 << j) - 1)).bit_count()
    while i and j:
        if left[i - 1] == right[j - 1]:
            same.add(left_at[i - 1])
            i, j = i - 1, j - 1
        elif count(i - 1, j) >= count(i, j - 1):
            i -= 1
        else:
            j -= 1
    return same


def line_hash(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode())).view(np.int64))


def main_text(own: list[tuple[int, int, str | None]], partner: list[int] | None) -> str:
    """Blocks of (hash, place, text) that neither the markup nor the partner's lines take away.

    Lines inside an article are main text even if the partner has them.  Where
    articles hold most of the text that the partner does not share, lines outside
    of them are frame; else articles are teasers beside the main text and
    differencing decides on the other lines.
    """
    drop = shared([h for h, _, _ in own], partner) if partner else set()
    article = any(place == ARTICLE for _, place, _ in own)
    inside = sum(len(t) for _, place, t in own if place == ARTICLE)
    outside = sum(len(t) for k, (_, place, t) in enumerate(own) if place == OUTSIDE and k not in drop)
    main = article and inside >= outside
    kept = [t for k, (_, place, t) in enumerate(own) if place == ARTICLE or place == OUTSIDE and not main and k not in drop]
    if not kept and not article:  # a copy of its partner: nothing tells frame and text apart
        kept = [t for _, place, t in own if place == OUTSIDE]
    return "\n\n".join(kept)


def lines(page: str) -> list[tuple[int, int, str | None]]:
    """Blocks with their hash; the text of those that are never main text is not carried on."""
    return [(line_hash(t), k, t if k != SKIP else None) for t, k in blocks(page)]


def packed(own: list[tuple[int, int, str | None]]) -> bytes:
    return zstandard.ZstdCompressor(level=9).compress(json.dumps(own, ensure_ascii=False).encode(errors="surrogatepass"))


def unpacked(data: bytes) -> list[tuple[int, int, str | None]]:
    return json.loads(zstandard.ZstdDecompressor().decompress(data).decode(errors="surrogatepass"))


@arrow_column("array<bigint>")
def _hashes(page: pa.Array) -> pa.Array:
    return pa.array([[line_hash(t) for t, _ in blocks(x or "")] for x in page.to_pylist()], pa.list_(pa.int64()))


@arrow_column("binary")
def _packed(page: pa.Array) -> pa.Array:
    """A page's lines; they cross the shuffle compressed."""
    return pa.array([packed(lines(x or "")) for x in page.to_pylist()], pa.binary())


@arrow_column("string")
def _main_text(own: pa.Array, partner: pa.Array) -> pa.Array:
    return pa.array([main_text(unpacked(a), b) for a, b in zip(own.to_pylist(), partner.to_pylist(), strict=True)], pa.string())


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; the path has no query or fragment."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return host, F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _common(a: Column, b: Column) -> Column:
    """Length of the common beginning of two paths, in segments and then characters of the next one."""
    one, two = F.split(a, "/"), F.split(b, "/")
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(one), F.size(two))), lambda i: F.slice(one, 1, i) == F.slice(two, 1, i)))
    return same


def nearest(keys: DataFrame) -> DataFrame:
    """``(row, partner)`` for ``keys`` of ``row, host, path``: the neighbour in address order on the same host.

    Rows are numbered over ranges of the sorted table: within each range first,
    then with the sizes of the ranges before it, which are few.
    """
    sorted_ = keys.repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row")
    local = written(sorted_.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "addresses")
    sizes = local.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = local.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select("row", "host", "path", (F.col("before") + F.col("at")).alias("rank"))
    ranked = ranked.select("host", "path", "row", "rank")
    a, b = ranked.alias("a"), ranked.alias("b")
    pairs = a.join(b, F.col("a.rank") + 1 == F.col("b.rank")).filter("a.host = b.host")
    near = pairs.select(F.col("a.row").alias("one"), F.col("b.row").alias("two"), _common(F.col("a.path"), F.col("b.path")).alias("near"))
    both = near.select(F.col("one").alias("row"), F.col("two").alias("partner"), "near").union(near.select(F.col("two").alias("row"), F.col("one").alias("partner"), "near"))
    return both.groupBy("row").agg(F.max(F.struct("near", F.col("partner"))).alias("best")).select("row", F.col("best.partner").alias("partner"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without the markup column, with ``text`` (empty if none) and ``n_chars``.

    A page is known by the hash of its address and markup, so equal rows are one
    page and get the same text.  It meets its partner's line hashes only: texts
    and markup of partners are not shuffled, and the pages' own lines only once.
    """
    key, own, partner = f"{OWN}key", f"{OWN}lines", f"{OWN}partner"
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (url_col, html_col)]
    keyed = pages.withColumn(key, F.unhex(F.md5(F.concat_ws("\n", *parts).cast("binary"))))
    host, path = split_url(F.col(url_col))
    known = written(keyed.select(F.col(key).alias("row"), host.alias("host"), path.alias("path"), _hashes(F.col(html_col)).alias("lines")), "page-lines")
    hashes = known.groupBy(F.col("row").alias("partner")).agg(F.first("lines").alias(partner))
    links = nearest(known.select("row", "host", "path").distinct()).join(hashes, "partner").select(F.col("row").alias(key), partner)
    out = keyed.withColumn(own, _packed(F.col(html_col))).drop(html_col).join(links, key, "left")
    return out.withColumn("text", _main_text(F.col(own), F.col(partner))).drop(key, own, partner).withColumn("n_chars", F.length("text").cast("bigint"))
