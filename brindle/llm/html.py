"""Main text of web pages by nearest-URL page differencing.

A page is read into text lines (one a block). Pages are put in the order of
host and URL path, dealt out in ranges; each is paired with the nearest page
before and after it on the same host that isn't a copy of it. The lines of
each pair are aligned by longest common subsequence, and lines that both have
are deleted: what a site repeats from page to page is its frame.

Copies of one article would delete each other. Pages are copies if the lines
that their texts would keep without differencing agree, by characters: frame
lines that no markup tells are many but short. Copies are one group, so the
nearest different page is found however many copies lie between.

Markup says two things. Elements that aren't content (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments) are left
out whatever the comparison finds; inside an article a class or id must name
such a thing as a whole. And paragraphs, headings, list items, quotations and
cells inside article elements are the articles' text, even if other pages have
them too: articles quote each other. The other blocks of an article are deleted
if two partners have them that are no copies of each other; a page without an
article element is its lines that no partner shares. All articles outside frame
elements are kept, in page order.

Only hashes of lines are shuffled and sorted, never pages. A page at the edge
of a range has partners on one side only. A task holds the hashes of one host
in its range.

Rows: null html is empty and gives an empty text; a null url is host ''.
Repeated rows and null ids are extracted like any other row. Only the named
columns are read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_small, materialize

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
#: Elements that are never the article's text.
_FRAME = frozenset("head nav footer aside form button select option input textarea label fieldset noscript iframe object embed svg canvas template dialog menu script style title audio video map".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, id or role that mark a part as frame.
_MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist respond reply replies cookie cookies consent gdpr notice notices disclaimer alert popup modal overlay footer header masthead menu navbar nav navigation newsletter subscribe subscription signup pager pagination promo promotion promoted recommended recommendations related share sharing social sidebar sponsor sponsored toolbar widget widgets search login skip contentinfo complementary discussion disqus".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: What may follow a mark in a class or id inside an article.
_PART = "ads? articles? area banners? bars? blocks? body box buttons? container content form group heading inner items? links? lists? posts? section slots? texts? title units? widgets? wrap wrapper".split()
_WHOLE = re.compile(rf"(?:{'|'.join(sorted(_MARKS))})(?:[-_]*(?:{'|'.join(_PART)}|[0-9]+))*")
#: Elements whose text, inside an article, is the article's.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption".split())
#: A tag whose quotes are never closed is read up to the next >.
_STARTS = re.compile(r"</?[a-zA-Z]")
_OPEN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")


def _is_frame(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _FRAME:
        return True
    if tag == "header" and not in_article:
        return True
    if not attributes or tag in ("body", "html", "article", "main") and "comment" not in attributes.lower():
        return False
    if _HIDDEN.search(attributes):
        return True
    for m in _ATTRIBUTE.finditer(attributes):
        value = _CAMEL.sub("-", m[1] or m[2] or m[3] or "").lower()
        if any(_WHOLE.fullmatch(w) for w in value.split()) if in_article else any(w in _MARKS for w in _SPLIT.split(value)):
            return True
    return False


def lines(page: str) -> list[tuple[str, bool, int, bool]]:
    """(text, in a frame element, number of its article or 0, prose of an article) of each text block, in page order."""
    out: list[tuple[str, bool, int, bool]] = []
    buffer: list[str] = []
    stack: list[str] = []
    frames: list[int] = []  # depths in the stack at which a frame element began
    articles: list[int] = []  # depths of open articles
    number, at, size = 0, 0, len(page)
    lowered: str | None = None

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                out.append((text, bool(frames), number if articles else 0, bool(articles) and not _PROSE.isdisjoint(stack[articles[0] :])))
            buffer.clear()

    def closed(tag: str) -> None:
        """Drop the innermost ``tag`` and what is open inside it."""
        while stack:
            top = stack.pop()
            if frames and frames[-1] >= len(stack):
                flush()
                frames.pop()
            if articles and articles[-1] >= len(stack):
                flush()
                articles.pop()
            if top == tag:
                break

    quoted = True  # until a tag turns up whose quotes are never closed: later ones would be looked for in vain
    while at < size:
        m = (_TOKEN if quoted or page[at] != "<" or page[at + 1 : at + 2] in "!?" else _OPEN_TAG).match(page, at)
        if quoted and m[0] == "<" and _STARTS.match(page, at):
            quoted, m = False, _OPEN_TAG.match(page, at)
        if m is None and (page[at + 1 : at + 2].isalpha() or page[at + 1 : at + 2] == "/") and page.find(">", at) < 0:
            buffer.append(page[at:].replace("<", "&lt;"))  # no tag can end any more
            break
        if m is None:
            buffer.append("&lt;")
            at += 1
            continue
        at = m.end()
        tag = m[2]
        if tag is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                buffer.append(token if token != "<" else "&lt;")
            elif token.startswith("<![CDATA["):
                buffer.append(html.escape(token[9:-3]))
            continue
        tag = tag.lower()
        if m[1]:
            if tag in _BLOCK or tag == "br":
                flush() if tag != "br" else buffer.append(" ")
            if tag in stack:
                closed(tag)
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            if "p" in stack and _BLOCK.isdisjoint(stack[len(stack) - stack[::-1].index("p") :]):
                closed("p")  # a block ends an open paragraph
        if tag in _RAW:
            lowered = page.lower() if lowered is None else lowered
            end = lowered.find(f"</{tag}", at)
            if len(lowered) == size:
                at = size if end < 0 else page.find(">", end) + 1 or size
            else:  # lower-casing changed offsets
                found = re.compile(f"</{tag}[^>]*>?", re.I).search(page, at)
                at = found.end() if found else size
            continue
        if tag in _VOID or m[3].endswith("/"):
            continue
        if tag in ("p", "li", "td", "th", "tr", "dd", "dt", "option") and tag in stack[-1:]:
            stack.pop()
        frame = _is_frame(tag, m[3], bool(articles))
        if tag in ("article", "main") and not frame:
            if frames and not articles and not any(stack[d] in ("form", "dialog", "template") for d in frames):
                # A menu that was never closed doesn't swallow the article.
                if all(stack[d] in ("nav", "header", "ul", "div", "aside") for d in frames) and f"</{stack[frames[0]]}" not in page[at:].lower():
                    frames.clear()
            if not articles and not frames:
                number += 1
                articles.append(len(stack))
        if frame:
            flush()
            frames.append(len(stack))
        stack.append(tag)
    flush()
    return out


def own_lines(found: list[tuple[str, bool, int, bool]]) -> list[int]:
    """The positions of the lines that a page's text may keep: those of its articles, if it has any, outside frame elements."""
    article = any(a and not frame for _, frame, a, _ in found)
    return [i for i, (_, frame, a, _) in enumerate(found) if not frame and (a or not article)]


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """The positions in ``a`` of a longest common subsequence with ``b``.

    Matches in order of ``a`` and, within a line, from the back of ``b``; the
    longest increasing run of these is the alignment (time by matches, not by
    the product of lengths).
    """
    low, most = 0, min(len(a), len(b))
    while low < most and a[low] == b[low]:  # what both begin and end with needs no search
        low += 1
    high = 0
    while high < most - low and a[-1 - high] == b[-1 - high]:
        high += 1
    if low or high:
        inner = common_lines(a[low : len(a) - high], b[low : len(b) - high]) if most > low + high else []
        return [*range(low), *(low + i for i in inner), *range(len(a) - high, len(a))]
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tails: list[int] = []
    nodes: list[tuple[int, int]] = []  # (position in a, node before or -1)
    ends: list[int] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            nodes.append((i, ends[k - 1] if k else -1))
            if k == len(tails):
                tails.append(j)
                ends.append(len(nodes) - 1)
            else:
                tails[k] = j
                ends[k] = len(nodes) - 1
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(nodes[n][0])
        n = nodes[n][1]
    return out[::-1]


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL, without scheme, user, port, query and fragment."""
    rest = (url or "").partition("://")[2] or (url or "")
    host, _, path = re.split(r"[?#]", rest, maxsplit=1)[0].partition("/")
    return host.rpartition("@")[2].partition(":")[0].lower(), path.rstrip("/")


#: Pages that share more of their texts' characters than this, by lines, are copies: no partners.
COPY = 0.8


class _Page:
    """The lines of a page: hashes of all, positions and lengths of those that its text may keep."""

    def __init__(self, key: int, hashes: np.ndarray, own: np.ndarray, sizes: np.ndarray, loose: np.ndarray, article: bool):
        self.key, self.hashes, self.own, self.sizes, self.article = key, hashes, own, sizes, article
        self.loose = set(loose.tolist())  # lines that differencing may delete
        self.total = int(sizes.sum())

    def mine(self) -> list[int]:
        return self.hashes[self.own].tolist()

    @cached_property
    def all(self) -> frozenset[int]:
        return frozenset(self.hashes.tolist())

    def copies(self, other: _Page) -> bool:
        least = COPY * max(self.total, other.total)
        mine, sizes = self.mine(), self.sizes.tolist()
        if sum(n for x, n in zip(mine, sizes, strict=True) if x in other.all) <= least:
            return least == 0
        return sum(sizes[i] for i in common_lines(mine, other.mine())) > least

    def shares(self, other: _Page) -> set[int]:
        """The positions of lines that may go and that ``other`` has too."""
        if not self.loose or other.all.isdisjoint(self.hashes[list(self.loose)].tolist()):
            return set()
        return set(common_lines(self.hashes.tolist(), other.hashes.tolist())) & self.loose


def partners(pages: list[_Page]) -> list[list[_Page]]:
    """For each page the nearest one before that isn't a copy of it, and the nearest that is a copy of neither.

    Copies are a group with its first page for all; the group met last comes last.
    Pages without text are nobody's partners.
    """
    groups: list[_Page] = []
    out = []
    for page in pages:
        found: list[_Page] = []
        own = None
        for at in range(len(groups) - 1, -1, -1):
            other = groups[at]
            if page.copies(other):
                own = at if own is None else own
            elif not found or not other.copies(found[0]):
                found.append(other)
            if len(found) == 2:
                break
        if page.total:
            groups.append(page if own is None else groups.pop(own))
        out.append(found)
    return out


def cuts(pages: list[_Page]) -> list[tuple[int, list[int]]]:
    """(key, positions of the lines to delete) of pages of one host in their order."""
    out = []
    for page, before, after in zip(pages, partners(pages), partners(pages[::-1])[::-1], strict=True):
        near = before[:1] + after[:1]
        if page.article and near:
            other = next((x for x in near[1:] + before[1:] + after[1:] if not x.copies(near[0])), None)
            cut = page.shares(near[0]) & page.shares(other) if other else set()
        else:
            cut = set().union(*map(page.shares, near))
        if cut:
            out.append((page.key, sorted(cut)))
    return out


def shared_lines(pages: DataFrame) -> DataFrame:
    """(key, cut): the positions of the lines of its text that a page shares with its partners."""

    def read(batches):
        for batch in batches:
            rows = []
            for key, url, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = lines(page or "")
                host, path = split_url(url)
                own = own_lines(found)
                article = any(found[i][2] for i in own)
                rows.append((key, host, path, [xxhash.xxh64_intdigest(x[0]) - 2**63 for x in found], own, [len(found[i][0]) for i in own], [i for i in own if not found[i][3]], article))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), *(pa.list_(pa.int32()),) * 3, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "host", "path", "hashes", "own", "sizes", "loose", "article"])

    def compare(batches):
        held: list[_Page] = []
        last = None

        def settled():
            done = cuts(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.list_(pa.int32()))], ["key", "cut"])

        for batch in batches:
            keys, hosts, articles = (batch.column(n).to_pylist() for n in ("key", "host", "article"))
            parts = [batch.column(n) for n in ("hashes", "own", "sizes", "loose")]
            for i, host in enumerate(hosts):
                if held and host != last:
                    yield settled()
                last = host
                held.append(_Page(keys[i], *(c[i].values.to_numpy(zero_copy_only=False).copy() for c in parts), articles[i]))
        yield settled()

    read_lines = materialize(pages.mapInArrow(read, "key long, host string, path string, hashes array<long>, own array<int>, sizes array<int>, loose array<int>, article boolean"), "lines")
    ranged = read_lines.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key")
    return ranged.mapInArrow(compare, "key long, cut array<int>")


def text_of(page: str | None, cut: list[int] | None = None) -> str:
    """The main text of a page, without the lines at ``cut``."""
    found = lines(page or "")
    gone = set(cut or ())
    kept = [found[i][0] for i in own_lines(found) if i not in gone]
    return "\n\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text (empty if none), n_chars (code points)."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    key = F.xxhash64("id", "url", "html")
    cuts = materialize(shared_lines(rows.select(key.alias("key"), "url", "html")).dropDuplicates(["key"]), "cuts")
    side = F.broadcast(cuts) if is_small(cuts) else cuts
    joined = rows.withColumn("key", key).join(side, "key", "left").select("id", "url", "html", "cut")

    def run(batches):
        for batch in batches:
            texts = [text_of(page.as_py(), cut.as_py()) for page, cut in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kind = joined.schema["id"].dataType.simpleString()
    out = joined.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
