"""Main text of web pages: landmarks of the markup, and suffix arrays of each host's token streams.

Markup, scripts and what the page itself names as menus, headers, footers, notices and the like go. All other
blocks of a host's pages are judged together: a suffix array over their concatenated words finds substrings of
``least`` words or more and on how many distinct pages they occur. On ``on`` pages they are boilerplate, inside an article or
main element (whose text may quote or repeat another's) only on a ``share`` of the host's pages; the runs between them stay.
Of what stays of a page with article or main elements, blocks outside them go, unless they hold more words.

Pages of one host meet in groups of bounded size. A large host has several, whose pages exchange hashes of their
windows of ``least`` words (and of whole shorter blocks): the numbers of pages that hold each are added up over
the host, and each group hears which of its own occur on enough pages, so groups bound memory and change no result.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallframe.llm.exchange import planes, unplanes
from tallframe.llm.text import hashes, map_batches, mix

#: Elements whose content is text to the parser, elements that hold no text of the page, blocks, elements without content, words of class names and ids of parts that aren't a page's text, and of what only says that there are such parts.
RAW = {"script", "style", "textarea", "title", "iframe"}
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog"}
INLINE = {"button", "noscript", "template", "object", "svg", "select", "audio", "video", "canvas"}
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
READERS = {"comment", "comments", "disqus", "replies", "reply", "respond", "responses"}
NOTICES = {"ad", "ads", "banner", "cookie", "cookies", "consent", "modal", "newsletter", "notice", "notices", "popup", "related", "share", "sharing", "social", "subscribe"}
PLACES = {"breadcrumb", "breadcrumbs", "footer", "masthead", "menu", "nav", "navbar", "navigation", "sidebar", "toolbar", "topbar", "widget"}
STEMS = ("advert", "promo", "sponsor")
STATES = {"no", "not", "has", "is", "with", "without", "show", "hide"}
OF_SITE = {"site", "page", "main", "global", "top", "blog"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"}
#: A start tag of the first ends open elements of the second.
IMPLIED = {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "td", "th", "tr")}
#: A tag's name and attributes end before the next tag begins and are never read again, so that tags that never close are passed in one step each; a tag with a stray quote ends at the first ``>``.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<more>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+(?=>)|[^<>]*+)>", re.S)
#: Most bytes of html in a group, unless a page has more.
GROUP_BYTES = 8 << 20
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
TELLING = re.compile(r"class|id|role|hidden", re.I)


def named(name: str, in_article: bool) -> str | None:
    """Which part of a page a class name or id is of: ``readers``, ``notice``, ``place`` or none of them.

    ``no-sidebar``, ``has-comments`` and ``content-sidebar-wrap`` are of wrappers, as is what follows two hyphens.
    """
    parts = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name.split("--")[0]).lower().replace("_", "-").split("-")
    if not STATES.isdisjoint(parts):
        return None
    if not READERS.isdisjoint(parts):
        return "readers"
    if not NOTICES.isdisjoint(parts) or any(x.startswith(STEMS) for x in parts):
        return "notice"
    if not PLACES.isdisjoint(parts) and not ("content" in parts and "sidebar" in parts and parts.index("content") < parts.index("sidebar")):
        return "place"
    if parts[-1] == "header" and not in_article and (len(parts) == 1 or parts[0] in OF_SITE):
        return "place"
    return None


@lru_cache(1 << 14)
def apart(tag: str, more: str, in_article: bool) -> str | None:
    """Why an element isn't the page's text: an ``element`` by its tag, role or attribute, a ``form``, or by ``named``; none if it may be."""
    if tag == "form":
        return "form"
    if tag in CHROME or tag in INLINE or (tag == "header" and not in_article):
        return "element"
    if tag in ("html", "body", "main"):
        return None
    found = None
    for name, value in ATTRIBUTE.findall(more):
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "element" if tag != "article" else None
        if name == "class" or name == "id" and tag not in HEADINGS:  # a heading's id is made of its words
            for x in value.split():
                why = named(x, in_article)
                if why and (tag != "article" or why == "readers"):
                    found = found or why
    return found


class Part:
    """An element that may be set apart, with what speaks against it."""

    def __init__(self, why: str, tag: str, above: int) -> None:
        self.why, self.tag, self.above = why, tag, above
        self.closed = self.main = self.article = False
        self.landmark = self.content = -1  # where the first article or main begins in it, and the first paragraph, title or section
        self.chars = self.links = 0
        self.until = -1  # what stands in it from here on stays; all if 0

    def decide(self, total: int, landmarks: bool) -> None:
        """``total``: letters of the page; ``landmarks``: whether an article or main element stands outside all parts."""
        if self.main or self.article and not landmarks:
            self.until = 0 if self.closed else self.landmark
        elif self.content >= 0 and not landmarks and 2 * self.chars > total and 2 * self.links < self.chars:
            if self.why == "form" or self.why == "place":
                self.until = 0 if self.closed else self.content
            elif not self.closed and self.why == "element" and self.tag != "footer":
                self.until = self.content


def blocks(page: str | None) -> tuple[list[str], list[bool]]:
    """The page's blocks of text but for those that its markup sets apart, and which of them stand in an article.

    An element that is set apart yields to a main element in it, and to an article if none stands elsewhere. A form, or what is
    named as a place of the page, yields too if it holds paragraphs, most of the page's letters and not mostly links. An
    element that never closes ends where its article begins, or before a paragraph if most of the page follows.
    """
    page = page or ""
    texts: list[list[tuple[int, int, str]]] = [[]]  # of a block: part, place and text
    inside: list[bool] = [False]
    parts: list[Part] = []
    open_: list[tuple[str, bool, int]] = []  # tag, whether it is an article, part
    held: dict[str, int] = {}  # how many of each tag are open
    ends: dict[str, list[int]] = {}  # where the elements of ``RAW`` end, by tag
    articles, part, link, inline = 0, -1, False, ""
    landmarks = False

    def close(to: int, closed: bool) -> None:
        """Closes elements, the outermost of them by its own end tag or by one that implies it."""
        nonlocal articles, part
        while len(open_) > to:
            tag, is_article, of = open_.pop()
            held[tag] -= 1
            articles -= is_article
            if of >= 0:
                part = parts[of].above
                parts[of].closed = closed and len(open_) == to

    def said(start: int, text: str) -> None:
        texts[-1].append((part, start, text))
        if not text.isspace():
            n, p = len(text), part
            while p >= 0 and p > part - 16:  # parts nest little; what counts is which holds most
                parts[p].chars += n
                parts[p].links += n if link else 0
                p = parts[p].above

    at, tokens = 0, TOKEN.finditer(page)
    while m := next(tokens, None):
        start, stop = m.span()
        if start > at:
            if part < 0:
                texts[-1].append((-1, at, page[at:start]))
            else:
                said(at, page[at:start])
        at = stop
        end, tag, more = m.groups()
        if tag is None:
            if m[0].startswith("<![CDATA["):
                said(start, html.escape(m[0][9:-3]))
            continue
        tag = tag.lower()
        single = more.endswith("/") or tag in VOID
        if tag in RAW:
            if not end and not single:
                if tag not in ends:
                    ends[tag] = [x.end() for x in re.finditer(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", page, re.I)]
                k = bisect_right(ends[tag], at)
                if k < len(ends[tag]):
                    at = ends[tag][k]
                elif tag in ("script", "style"):
                    at = len(page)
                tokens = TOKEN.finditer(page, at)
            continue
        if tag not in BLOCKS:
            if tag == "br":
                said(start, " ")
            elif tag == "a":
                link = not end
            if end:
                if held.get(tag):
                    k = len(open_) - 1
                    while open_[k][0] != tag and open_[k][0] not in BLOCKS:
                        k -= 1
                    if open_[k][0] == tag:
                        close(k, True)
                        inline = inline if held[tag] else ""
            elif not single:
                why = None
                if not inline and (tag in INLINE or more and TELLING.search(more)):
                    why = apart(tag, more if tag not in INLINE else "", articles > 0)
                if why:
                    parts.append(Part(why, tag, part))
                    part, inline = len(parts) - 1, tag
                if why or tag == inline:
                    open_.append((tag, False, part if why else -1))
                    held[tag] = held.get(tag, 0) + 1
            continue
        if end:
            if held.get(tag):
                k = len(open_) - 1
                while open_[k][0] != tag:
                    k -= 1
                close(k, True)
        elif not single:
            implied = IMPLIED.get(tag, ("p",))
            while open_ and open_[-1][0] in implied:
                close(len(open_) - 1, True)
        if inline and not held[inline]:
            inline = ""
        if texts[-1] or inside[-1] != (articles > 0):
            texts.append([])
            inside.append(False)
        if not end and not single:
            why = apart(tag, more if more and TELLING.search(more) else "", articles > 0)
            is_article = tag == "main" or tag == "article" and not why
            if is_article and part < 0:
                landmarks = True
            if part >= 0 and (is_article or tag in ("p", "h1", "section")):
                p = part
                while p >= 0 and (parts[p].content < 0 or is_article and (parts[p].landmark < 0 or tag == "main" and not parts[p].main)):
                    x = parts[p]
                    x.content = start if x.content < 0 else x.content
                    if is_article:
                        x.landmark = start if x.landmark < 0 else x.landmark
                        x.main, x.article = x.main or tag == "main", True
                    p = x.above
            if why:
                parts.append(Part(why, tag, part))
                part = len(parts) - 1
            open_.append((tag, is_article, part if why else -1))
            held[tag] = held.get(tag, 0) + 1
            articles += is_article
        inside[-1] = articles > 0
    if at < len(page):
        said(at, page[at:])
    close(0, False)
    if parts:
        total = sum([len(x) for t in texts for _, _, x in t if not x.isspace()])
        for x in parts:
            x.decide(total, landmarks)
        gone_until = [0] * len(parts)  # what stands in a part before this place goes
        for k, x in enumerate(parts):
            own = len(page) + 1 if x.until < 0 else x.until
            gone_until[k] = max(own, gone_until[x.above] if x.above >= 0 else 0)
    out, main = [], []
    for t, i in zip(texts, inside, strict=True):
        if not t:
            continue
        text = t[0][2] if len(t) == 1 and t[0][0] < 0 else "".join([x for p, place, x in t if p < 0 or place >= gone_until[p]])
        if text := " ".join((html.unescape(text) if "&" in text else text).split()):
            out.append(text)
            main.append(i)
    return out, main


def suffix_array(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order of their first ``depth`` codes, by prefix doubling, and how many codes each shares with the one before it, up to that."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    ranks, width = [rank], 1
    order = np.argsort(rank, kind="stable")
    while width < depth and rank.max() < n:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - width)] = rank[width:]
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(True, sorted_[1:] != sorted_[:-1]))
        ranks.append(rank)
        width *= 2
    shared = np.zeros(n, np.int64)
    a, b = order[1:], order[:-1]
    for level in range(len(ranks) - 1, -1, -1):
        r = np.append(ranks[level], 0)
        i, j = np.minimum(a + shared[1:], n), np.minimum(b + shared[1:], n)
        shared[1:] += np.where((r[i] == r[j]) & (i < n) & (j < n), 1 << level, 0)
    return order, shared


def repeated(words: list[list[str]], page: np.ndarray, least: int, need: np.ndarray) -> list[np.ndarray]:
    """Which words of each block lie in a substring of ``least`` words (a whole block, if it is shorter) that occurs on as many distinct pages as that block needs."""
    code: dict[str, int] = {}
    parts, starts, at = [], [], 0
    for k, w in enumerate(words):  # each block ends in a code of its own
        starts.append(at)
        parts.append([code.setdefault(x, len(code)) for x in w])
        parts.append([-1 - k])
        at += len(w) + 1
    stream = np.concatenate([np.array(p, np.int64) for p in parts])
    sizes = [len(w) + 1 for w in words]
    owner, enough = np.repeat(page, sizes), np.repeat(need, sizes)
    order, shared = suffix_array(stream, max(least, 2))
    run = np.cumsum(shared < least)
    pairs = np.unique(run * (owner.max() + 1) + owner[order])
    many = np.bincount(pairs // (owner.max() + 1), minlength=run.max() + 1)
    edge = np.zeros(len(stream) + 1, np.int64)
    hit = order[(many[run] >= enough[order]) & (order + least < len(stream) + 1)]
    np.add.at(edge, hit, 1)
    np.add.at(edge, np.minimum(hit + least, len(stream)), -1)
    covered = np.cumsum(edge[:-1]) > 0
    out = [covered[s : s + len(w)] for s, w in zip(starts, words, strict=True)]
    short: dict[tuple[str, ...], set[int]] = {}
    for w, p in zip(words, page.tolist(), strict=True):
        if len(w) < least:
            short.setdefault(tuple(w), set()).add(p)
    return [np.full(len(w), len(short[tuple(w)]) >= n) if len(w) < least else c for w, c, n in zip(words, out, need.tolist(), strict=True)]


def windows(words: list[list[str]], least: int) -> list[np.ndarray]:
    """64-bit hashes of each block's windows of ``least`` words; a shorter block has one, of the whole."""
    if not words:
        return []
    code: dict[str, int] = {}
    sizes = np.array([len(w) for w in words], np.int64)
    stream = np.fromiter((code.setdefault(x, len(code)) for w in words for x in w), np.int64, sizes.sum())
    codes = hashes([x.encode("utf-8", "surrogatepass") for x in code])[stream]
    width = np.minimum(sizes, least)
    many = sizes - width + 1
    ends = np.cumsum(many)
    at = np.arange(ends[-1]) + np.repeat(np.cumsum(sizes) - sizes - ends + many, many)
    width = np.repeat(width, many)
    sums, shortest = width.astype(np.uint64), width.min()
    for k in range(least):
        which = slice(None) if k < shortest else np.flatnonzero(width > k)
        sums[which] = sums[which] * np.uint64(0x9E3779B97F4A7C15) + codes[at[which] + k]
    return np.split(mix(sums).view(np.int64), ends[:-1])


def told(pages: list[str | None], least: int) -> Iterator[np.ndarray]:
    """The distinct windows of each page, some megabytes of pages at a time."""
    start, held = 0, 0
    for k, page in enumerate(pages):
        held += len(page or "")
        if held < 1 << 21 and k + 1 < len(pages):
            continue
        found = [blocks(x)[0] for x in pages[start : k + 1]]
        of = windows([x.split(" ") for b in found for x in b], least)
        ends = np.cumsum([len(b) for b in found])
        for b, end in zip(found, ends.tolist(), strict=True):
            yield np.unique(np.concatenate(of[end - len(b) : end])) if b else np.array([], np.int64)
        start, held = k + 1, 0


def packed(part: np.ndarray, found: np.ndarray, shards: int) -> pa.RecordBatch:
    """Distinct hashes of each part and how often each occurs, by ranges of hashes (a power of two of them): sorted, so that their differences are short."""
    order = np.lexsort((found, part))
    part, found = part[order], found[order]
    first = np.flatnonzero(np.append(True, (found[1:] != found[:-1]) | (part[1:] != part[:-1]))[: len(found)])
    n = np.diff(np.append(first, len(found))).astype(np.uint32)
    part, found = part[first], found[first]
    shard = (found >> np.uint64(65 - shards.bit_length())).astype(np.int32)
    cut = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (part[1:] != part[:-1]))[: len(found)])
    ends = np.append(cut[1:], len(found))
    hashes_ = [planes(np.diff(found[i:j], prepend=np.uint64(0))) for i, j in zip(cut, ends, strict=True)]
    counts = [planes(n[i:j]) for i, j in zip(cut, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(shard[cut]), pa.array(part[cut]), pa.array((ends - cut).astype(np.int64)), pa.array(hashes_, pa.binary()), pa.array(counts, pa.binary())], names=["shard", "part", "many", "hashes", "counts"])


def unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts, hashes and counts of ``packed``, one after the other."""
    found = [np.cumsum(unplanes(x, np.uint64), dtype=np.uint64) for x in t.column("hashes").to_pylist()]
    n = [unplanes(x, np.uint32) for x in t.column("counts").to_pylist()]
    part = np.repeat(t.column("part").to_numpy(), t.column("many").to_numpy())
    return part, np.concatenate([*found, np.empty(0, np.uint64)]), np.concatenate([*n, np.empty(0, np.uint32)]).astype(np.int64)


def extract_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html_: str = "html", least: int = 8, on: int = 3, share: float = 0.5, group: int = 2000) -> DataFrame:
    """The main text of each page: ``page_id, url, text, n_chars``.

    Blocks have single spaces for white space and are joined by two line feeds; character references are
    decoded. A null or empty page has an empty text, and so has one without text. A null url is a host of
    its own name. Repeated rows each have a result and count as pages of their own. An empty table gives no rows;
    other columns aren't read. ``least``: words of a repeated substring; ``on``: pages that hold it, inside
    articles ``share`` of the host's pages if these are more; ``group``: about how many pages at most are compared at once.
    """
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[^:/?#]+:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html_).alias("html"), F.xxhash64(host).alias("host"))
    parts = F.ceil(F.greatest(F.count("*") / group, F.sum(F.octet_length("html")) / GROUP_BYTES)).cast("int")
    large = rows.groupBy("host").agg(parts.alias("groups"), F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes")).where("groups > 1")
    split, size = large.agg(F.count("*"), F.sum("bytes")).first()
    shards = 1 << max(3, math.ceil(math.log2((size or 1) / GROUP_BYTES)))
    if split <= 100_000:
        large = F.broadcast(large)
    rows = rows.join(large.drop("bytes"), "host", "left")
    rows = rows.withColumn("part", F.expr("xxhash64(host, pmod(xxhash64(page_id, url, html), coalesce(groups, 1)))"))

    def parse(b: dict[str, list]) -> dict[str, list]:
        pack = zstandard.ZstdCompressor()
        found = [blocks(x) for x in b["html"]]  # no block has a line feed
        return {"blocks": [pack.compress("\n".join(x).encode("utf-8", "surrogatepass")) if x else b"" for x, _ in found], "inside": [bytes(y) for _, y in found]}

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2500):
                b = whole.slice(start, 2500).to_pydict()
                of = [w ^ np.int64(at) for w, at in zip(told(b["html"], least), b["host"], strict=True)]
                yield packed(np.repeat(np.array(b["part"], np.int64), [len(w) for w in of]), np.concatenate(of).view(np.uint64), shards)

    def count(t: pa.Table) -> pa.Table:
        part, found, n = unpacked(t)
        order = np.lexsort((part, found))
        part, found, n = part[order], found[order], n[order]
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1])[: len(found)])
        held = np.add.reduceat(n, first) if len(first) else n
        several = part[first] != part[np.append(first[1:], len(found)) - 1] if len(first) else first > 0
        times = np.diff(np.append(first, len(found)))
        keep = np.repeat((held >= on) & several, times)
        held = np.repeat(held, times)[keep]
        pairs = pa.table({"part": part[keep], "_hash": found[keep].view(np.int64), "n": held.astype(np.int64)})
        return pairs.group_by(["part", "_hash", "n"]).aggregate([])

    parsed = map_batches(rows, {"blocks": "binary", "inside": "binary"}, parse, read=["html"], keep=["page_id", "url", "part", "host", "n"])

    def judge(t: pa.Table, heard: pa.Table | None) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        of = [unpack.decompress(x).decode("utf-8", "surrogatepass").split("\n") if x else [] for x in t.column("blocks").to_pylist()]
        inside = [x > 0 for b in t.column("inside").to_pylist() for x in b]
        texts_of = [x for b in of for x in b]
        need = np.where(np.array(inside, bool), max(on, math.ceil(share * (t.column("n")[0].as_py() or len(of)))), on)
        words = [x.split(" ") for x in texts_of]
        page = np.repeat(np.arange(len(of)), [len(b) for b in of])
        covered = repeated(words, page, least, need) if words else []
        if heard is not None and heard.num_rows:
            found = windows(words, least)
            hashes_, counts = (heard.column(c).to_numpy() for c in ("_hash", "n"))
            order = np.argsort(hashes_)
            hashes_, counts = hashes_[order], counts[order]
            for c, x, enough in zip(covered, found, need.tolist(), strict=True):
                x = x ^ np.int64(t.column("host")[0].as_py())
                k = np.minimum(np.searchsorted(hashes_, x), len(hashes_) - 1)
                for at in np.flatnonzero((hashes_[k] == x) & (counts[k] >= enough)):
                    c[at : at + least] = True
        left = [[x for x, y in zip(w, c.tolist(), strict=True) if not y] if c.any() else w for w, c in zip(words, covered, strict=True)]
        lead = np.zeros(len(of), np.int64)  # words that stay inside landmarks, less those that stay outside
        np.add.at(lead, page, [len(w) if i else -len(w) for w, i in zip(left, inside, strict=True)])
        out: list[list[str]] = [[] for _ in of]
        marked = set(page[np.array(inside, bool)].tolist())
        for w, whole, x, p, i in zip(left, words, texts_of, page.tolist(), inside, strict=True):
            if w and (i or p not in marked or lead[p] < 0):
                out[p].append(x if w is whole else " ".join(w))
        texts = ["\n\n".join(x) for x in out]
        return pa.table({"page_id": t.column("page_id"), "url": t.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})

    kind = pages.schema[page_id].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars bigint"
    if not split:
        return parsed.groupBy("part").applyInArrow(lambda t: judge(t, None), schema)
    heard = rows.where("groups > 1").select("html", "host", "part").mapInArrow(tell, "shard int, part bigint, many bigint, hashes binary, counts binary")
    heard = heard.groupBy("shard").applyInArrow(count, "part bigint, _hash bigint, n bigint")
    return parsed.groupBy("part").cogroup(heard.groupBy("part")).applyInArrow(judge, schema)
