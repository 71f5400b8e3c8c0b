"""Main-text extraction from HTML, with a suffix array per host as evidence of boilerplate.

A page is parsed into blocks in page order. Structure settles most of them: blocks of the article (or main)
element are text, blocks of menus, headers, footers, asides, forms, adverts, notices, comments and the like are not.
What structure leaves open (every block of a page without an article or main element, and blocks of bare
containers beside headings) is settled by repetition: the token streams of a host's pages, without what is text
for certain, are concatenated and suffix-sorted. A run of RUN tokens, a block's first RUN - 1, and a shorter block as
a whole are boilerplate where LEAST_PAGES pages of the host with different streams hold them, whatever the host's
size; the tokens of open blocks that such runs cover are removed, and the unique runs between them stay. Pages with
equal streams count once, so that copies of a page don't remove each other. A host is dealt to cells of bounded
bytes, each with its own suffix array, equal streams to the same cell; page counts of equal substrings are summed
over the cells, so that nothing depends on the deal. Every host has its suffix arrays and every page its covered
tokens, counted in n_boilerplate, whether it has open blocks or not; what structure is certain of comes after them.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, join_sized, lean, persisted

#: Tokens of a repeated substring; least distinct pages that hold it.
RUN, LEAST_PAGES = 12, 3
#: Bytes of streams (8 a token) in one suffix array, about.
CELL_BYTES = 4 << 20
#: Before and after a block's tokens in a stream that is sorted.
START, END = np.uint64(1), np.uint64(3)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.IGNORECASE)
RAW = {"script", "style", "title", "textarea", "xmp", "noscript", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "button", "svg", "object", "template", "canvas", "audio", "video", "map"}
DROP = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "object", "svg", "template", "canvas", "dialog", "menu", "audio", "video", "map", "fieldset"}
HEADING = ("h1", "h2", "h3", "h4", "h5", "h6")
SOLID = ("p", "li", "blockquote", "pre", "dd", "dt", "tr", "figcaption", "summary")
#: Words of class, id and role that name what isn't the article.
FURNITURE = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar widget widgets related recommended share sharing social comment comments respond reply replies disqus menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar subscribe subscription newsletter signup login pagination pager skip toolbar complementary contentinfo search header disclaimer teaser trending".split()
)
COMMENTS = {"comment", "comments", "reply", "replies", "related", "teaser", "promo", "ad", "ads", "sponsored"}
BODY = {"articlebody", "main"}


def _names(attributes: str) -> set[str]:
    return {w for m in NAMES.finditer(attributes) for w in re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower())}


class Blocks:
    """Blocks of one page: (text, state), state 'text', 'open' or 'furniture'. What is asked of the open elements is counted as they come and go, so that deep nesting costs no more than flat pages."""

    def __init__(self, source: str):
        self.found: list[tuple[str, bool, bool, bool]] = []  # text, inside article or main, dropped, heading or paragraph
        self.words: list[str] = []
        self.stack: list[tuple[str, bool, bool, bool]] = []  # name, drops, is main, only headings
        self.places: dict[str, list[int]] = defaultdict(list)  # of each name, and of all blocks, in the stack
        self.dropping = self.mains = self.articles = self.heading_only = 0
        self._parse(source)

    def _count(self, entry: tuple[str, bool, bool, bool], by: int) -> None:
        name, drops, main, only = entry
        self.dropping += by * drops
        self.mains += by * main
        self.articles += by * (main and name == "article")
        self.heading_only += by * only

    def _push(self, name: str, drops: bool, main: bool, only: bool) -> None:
        for key in (name, "*block") if name in BLOCK else (name,):
            self.places[key].append(len(self.stack))
        self.stack.append((name, drops, main, only))
        self._count(self.stack[-1], 1)

    def _cut(self, k: int) -> None:
        while len(self.stack) > k:
            entry = self.stack.pop()
            self._count(entry, -1)
            for key in (entry[0], "*block") if entry[0] in BLOCK else entry[:1]:
                self.places[key].pop()

    def _last(self, *names: str) -> int:
        """The highest place of elements of these names in the stack, or -1."""
        return max((self.places[n][-1] for n in names if self.places[n]), default=-1)

    def _flush(self) -> None:
        if self.words:
            text = " ".join(html.unescape("".join(self.words)).split())
            self.words = []
            if text:
                heading = self._last(*HEADING) >= 0
                dropped = self.dropping > 0 or (self.heading_only > 0 and not (heading and self.mains > 0))
                self.found.append((text, self.mains > 0, dropped, heading or self._last(*SOLID) >= 0))

    def _open(self, name: str, attributes: str) -> None:
        names = _names(attributes) if attributes else set()
        main = name in ("article", "main") or bool(names & BODY and "main" in names and name in ("div", "section"))
        hidden = bool(attributes and HIDDEN.search(attributes))
        if name in ("article", "main", "body", "html"):
            drops = (name == "article" and bool(names & COMMENTS)) and (self.articles > 0 or bool(names & {"comment", "comments", "reply"}))
            self._push(name, drops or hidden, main, False)
            return
        headings_only = name == "header" or (bool(names & {"header"}) and not names & (FURNITURE - {"header"}))
        drops = name in DROP or hidden or bool(names & (FURNITURE - {"header"}))
        if name in BLOCK or drops or headings_only:
            self._push(name, drops, main, headings_only and not drops)

    def _parse(self, source: str) -> None:
        at = 0
        while True:
            m = TAG.search(source, at)
            if not m:
                break
            if m.start() > at:
                self.words.append(source[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            closing, attributes = m[1] or m[4], m[3] if m[2] else m[6] or ""
            if closing:
                if name in BLOCK:
                    self._flush()
                k = self._last(name)
                if k >= 0 and (name in BLOCK or self._last("*block") < k):
                    self._flush()
                    self._cut(k)
                continue
            if name in RAW:
                end = re.compile(f"</{name}[\\s/>]", re.IGNORECASE).search(source, at)
                if not end:
                    at = len(source)
                    break
                at = source.find(">", end.start())
                at = len(source) if at < 0 else at + 1
                continue
            if name == "br" or name in ("td", "th", "wbr", "img"):
                self.words.append(" " if name != "wbr" else "")
                continue
            if name in BLOCK or name == "hr":
                self._flush()
                k = self._last("p")
                if k >= 0 and self._last("table", "button", "object") < k:
                    self._cut(k)
                if name == "li" and (k := self._last("li")) > self._last("ul", "ol", "menu"):
                    self._cut(k)
            if name in VOID or attributes.endswith("/") and name in ("svg", "object"):
                continue
            if name not in BLOCK:
                names = _names(attributes) if attributes else set()
                if names & FURNITURE or (attributes and HIDDEN.search(attributes)):
                    self._flush()
            self._open(name, attributes)
        if at < len(source):
            self.words.append(source[at:])
        self._flush()

    def states(self) -> list[tuple[str, str]]:
        main = any(inside and not dropped for _, inside, dropped, _ in self.found)
        out = []
        for text, inside, dropped, solid in self.found:
            if dropped or (main and not inside):
                out.append((text, "furniture"))
            else:
                out.append((text, "text" if main and solid else "open"))
        return out


# -- pages ---------------------------------------------------------------------------

PARSED = "page_id long, url string, host string, blocks array<struct<text:string,open:boolean>>, stream binary, sizes binary"
HOST = re.compile(r"://([^/?#]*)")


def _tokens(text: str) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in text.split()], np.uint64)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages to their blocks without furniture. stream: token numbers of blocks that aren't text for certain; sizes: tokens of each of those, negative for furniture."""
    for b in batches:
        rows = []
        for page, url, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
            states = Blocks(source or "").states()
            host = HOST.search(url or "")
            unsure = [(t, s) for t, s in states if s != "text"]
            tokens = [_tokens(t) for t, _ in unsure]
            sizes = np.array([len(x) if s == "open" else -len(x) for x, (_, s) in zip(tokens, unsure, strict=True)], "<i4")
            kept = [{"text": t, "open": s == "open"} for t, s in states if s != "furniture"]
            rows.append((page, url, host[1].lower() if host else "", kept, np.concatenate(tokens).tobytes() if tokens else b"", sizes.tobytes()))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("text", pa.string()), ("open", pa.bool_())])), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "url", "host", "blocks", "stream", "sizes"])


def suffix_order(tokens: np.ndarray, depth: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a token sequence by prefix doubling, ordered by the first `depth` tokens or more, and each suffix's rank."""
    _, rank = np.unique(tokens, return_inverse=True)
    n, span = len(tokens), 1
    order = np.argsort(rank, kind="stable")
    while span < depth:
        far = np.concatenate([rank[span:] + 1, np.zeros(min(span, n), rank.dtype)])
        key = rank.astype(np.int64) * (int(rank.max(initial=0)) + 2) + far
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]])) if n else 0
        span *= 2
    return order, rank


def layout(stream: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stream as it is sorted, START before and RUN - 1 ENDs after each block: (tokens, places where a substring may start, the stream's place at each of those, tokens that it covers)."""
    t = np.frombuffer(stream, "<u8")
    n = np.abs(np.frombuffer(sizes, "<i4")).astype(np.int64)
    block = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    out = np.full(len(t) + RUN * len(n), END)
    heads = first + RUN * np.arange(len(n))
    out[heads] = START
    inner = np.arange(len(t)) + RUN * block + 1
    out[inner] = t
    left = first[block] + n[block] - np.arange(len(t))
    whole = left >= RUN
    starts = np.concatenate([heads[n > 0], inner[whole]])
    places = np.concatenate([first[n > 0], np.arange(len(t))[whole]])
    covers = np.concatenate([np.minimum(n[n > 0], RUN - 1), np.full(int(whole.sum()), RUN)])
    return out, starts, places, covers


def numbers(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of the RUN tokens from each start."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(RUN):
        out = (out ^ tokens[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _repeats(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a cell: each distinct substring (its number) and the distinct streams that hold it, from intervals of the suffix array. Where the host has no other cell, those of LEAST_PAGES streams alone."""
    pages = [layout(t, z) for t, z in dict.fromkeys(zip(pdf["stream"], pdf["sizes"], strict=True))]
    ends = np.cumsum([len(p[0]) for p in pages])
    flat = np.concatenate([p[0] for p in pages])
    page = np.full(len(flat), -1)
    for i, (p, end) in enumerate(zip(pages, ends, strict=True)):
        page[p[1] + end - len(p[0])] = i
    order, _ = suffix_order(flat)
    order = order[page[order] >= 0]
    same = np.ones(max(0, len(order) - 1), bool)
    for k in range(RUN):
        same &= flat[order[1:] + k] == flat[order[:-1] + k]
    interval = np.concatenate([[0], np.cumsum(~same)])[: len(order)]
    pair = np.unique(interval * np.int64(len(pages)) + page[order])
    count = np.bincount(pair // len(pages))
    first = np.flatnonzero(np.concatenate([[True], ~same]))[: len(count)]
    if key[2] == 1:
        first, count = first[count >= LEAST_PAGES], count[count >= LEAST_PAGES]
    return pd.DataFrame({"host": np.full(len(first), key[0]), "number": numbers(flat, order[first]), "pages": count.astype(np.int64)})


def _places(batches):
    """(uid, host, number, place, covers) of each substring of a stream, the last two in one number."""
    for b in batches:
        found = [[np.zeros(0, np.int64)] * 4]
        for uid, host, stream, sizes in zip(*(c.to_pylist() for c in b.columns), strict=True):
            flat, starts, places, covers = layout(stream, sizes)
            found.append([np.full(len(starts), uid), np.full(len(starts), host), numbers(flat, starts), places << 8 | covers])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["uid", "host", "number", "at"])


def _settle(batches):
    """Text of pages, without the tokens of open blocks that repeated substrings cover; n_boilerplate: tokens that they cover in all blocks but those that are text for certain."""
    for b in batches:
        out = []
        for row in b.to_pylist():
            sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
            hit = np.zeros(int(np.abs(sizes).sum()), bool)
            for x in row["places"] or []:
                hit[x >> 8 : (x >> 8) + (x & 255)] = True
            ends = np.cumsum(np.abs(sizes))
            kept = [~hit[e - n : e] for n, e in zip(sizes.tolist(), ends.tolist(), strict=True) if n > 0]
            texts, k = [], 0
            for x in row["blocks"]:
                text = x["text"]
                if x["open"]:
                    text = " ".join(w for w, stays in zip(text.split(" "), kept[k], strict=True) if stays)
                    k += 1
                if text:
                    texts.append(text)
            out.append((row["page_id"], row["url"], "\n\n".join(texts), int(hit.sum())))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "url", "text", "n_boilerplate"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_boilerplate (see _settle), n_chars of every row of pages (page_id, url, html).

    Null or empty html: empty text. Null url, or one without a host: the host ''. Repeated rows give a row each.
    Other columns are ignored. Empty table: empty result. Cut-off pages are read to their end, unclosed elements end
    with what holds them; very long and deeply nested pages are read in one pass.
    """
    parsed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(lean(_parse), PARSED)
    parsed = bucketed(parsed.withColumn("host", F.xxhash64("host")).withColumn("uid", F.monotonically_increasing_id()), "uid")
    own = parsed.where("length(stream) > 0").select("uid", "host", "stream", "sizes")
    bytes_ = persisted(own.groupBy("host").agg(F.ceil(F.sum(F.length("stream")) / F.lit(CELL_BYTES)).alias("cells")))
    cells = join_sized(own.drop("uid"), bytes_, "host", "inner", 24).withColumn("cell", F.pmod(F.xxhash64("stream", "sizes"), F.col("cells")))
    counted = cells.distinct().groupBy("host", "cell", "cells").applyInPandas(_repeats, "host long, number long, pages long")
    repeated = persisted(counted.groupBy("host", "number").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= LEAST_PAGES).select("host", "number"))
    places = join_sized(own.mapInArrow(lean(_places), "uid long, host long, number long, at long"), repeated, ["host", "number"], "left_semi", 24)
    places = places.groupBy("uid").agg(F.collect_list("at").alias("places"))
    settled = parsed.join(places.hint("shuffle_hash"), "uid", "left").select("page_id", "url", "blocks", "sizes", "places")  # the pages stay in their buckets
    return settled.mapInArrow(lean(_settle), "page_id long, url string, text string, n_boilerplate long").withColumn("n_chars", F.length("text").cast("long"))
