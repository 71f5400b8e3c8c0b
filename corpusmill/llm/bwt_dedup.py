"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

Every WINDOW-byte string that starts in a document is compared with all others, and the bytes of those that also
start in a document with a smaller id are removed. All suffixes of all documents don't fit one sort, so strings
meet by content:

1. Documents are laid into chunks. In each WINDOW-byte string the K-byte string with the least hash (the leftmost
   of equals) is its anchor, so equal strings have equal anchors at equal places. Consecutive strings with the
   same anchor place form a run; a run's text is at most 2 * WINDOW - K bytes.
2. Short fingerprints of the anchors are dealt to buckets; those found in two documents come back to their chunks.
   A false match costs work, never correctness.
3. The texts of the runs with such anchors, distinct ones of a chunk with the least document id, meet by anchor.
   Equal texts become one; those that share a string with another text, by its hash, are dealt to shards by their
   chunk, and each shard has its own Burrows-Wheeler transform. The transforms are merged by iterative
   interleave refinement: in round h the interleave is stable-sorted by the symbols before the suffixes that round
   h - 1 placed, so that after h rounds suffixes are ordered by their first h bytes, and the boundaries that have
   appeared by then part suffixes whose common prefix is shorter than h. After WINDOW rounds the intervals without a boundary are the repeated
   strings; no suffix of one shard is compared with one of another, and nothing is sorted anew.
4. The least document of every interval goes back to the chunks of its members, where covered bytes are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bucketed, lean, lean_group, persisted

WINDOW, K = 50, 20
#: Bytes of text in a chunk (one longer document is a chunk of its own), and of all text for which there is a bucket.
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 3 << 20
#: Bytes of text whose anchors and texts leave a task together, a row for each bucket.
GROUP_BYTES = 16 << 20
#: Strings of a chunk that are hashed in one go.
BLOCK = 1 << 17
#: Runs whose anchor has more texts than this (distinct ones of a chunk) meet string by string instead of by anchor, so
#: that a very common anchor with ever different surroundings is spread over all buckets.
HOT_TEXTS = 1000
#: Rank of a null doc_id: after every other.
LAST = np.iinfo(np.int64).max

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(9)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(_BASE, 1 << 16)
_BACK = _powers(_INVERSE, 1 << 16)


def _power_at(table: np.ndarray, base: np.uint64, at: np.ndarray) -> np.ndarray:
    """base ** at, from two tables."""
    high = _powers(np.uint64(pow(int(base), 1 << 16, 1 << 64)), int(at.max() >> 16) + 1 if len(at) else 1)
    return table[at & 0xFFFF] * high[at >> 16]


def sums(text: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash, modulo 2^64."""
    n = len(text)
    out = np.empty(n + 1, np.uint64)
    out[0] = 0
    for i in range(0, n, 1 << 16):
        block = _TABLE[text[i : i + (1 << 16)]]
        block *= _POWER[: len(block)]
        if i:
            block *= np.uint64(pow(int(_BASE), i, 1 << 64))
        np.cumsum(block, out=out[i + 1 : i + 1 + len(block)])
        out[i + 1 : i + 1 + len(block)] += out[i]
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hash_at(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of text[start:end] for arrays of places."""
    return _mixed((s[end] - s[start]) * _power_at(_BACK, _INVERSE, start))


def runs_of(text: np.ndarray, offsets: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string, last string, anchor place) of each run, in order. Strings that would cross a document's end are left out."""
    n = len(text)
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty, empty, empty
    s = sums(text)
    want = window - k + 1
    strings = n - window + 1
    firsts, before, anchors = [], [], []  # of each run: its first string, the string in a document before that, its anchor
    string, anchor = -2, -1
    for start in range(0, strings, BLOCK):  # blocks keep what is known of a chunk's strings out of memory
        end = min(start + BLOCK, strings) + want - 1
        least = _mixed((s[start + k : end + k] - s[start:end]) * _power_at(_BACK, _INVERSE, np.arange(start, end)))
        here, span = np.arange(start, end, dtype=np.int32), 1
        while span < want:
            step = min(span, want - span)
            right = least[step:]
            left = least[: len(right)]
            take = right < left
            here = np.where(take, here[step:], here[: len(right)])
            least = np.where(take, right, left)
            span += step
        at = np.arange(start, start + len(here))
        inside = at + window <= offsets[np.searchsorted(offsets, at, "right")]
        at, p = at[inside], here[inside].astype(np.int64)
        if len(at):
            previous = np.concatenate([[string], at[:-1]])
            new = np.flatnonzero((p != np.concatenate([[anchor], p[:-1]])) | (at != previous + 1))
            firsts.append(at[new])
            before.append(previous[new])
            anchors.append(p[new])
            string, anchor = int(at[-1]), int(p[-1])
    if not firsts:
        return empty, empty, empty
    return np.concatenate(firsts), np.concatenate([*before, [string]])[1:], np.concatenate(anchors)


# -- chunks ------------------------------------------------------------------

CHUNK = "ids binary, ranks binary, offsets binary, runs binary, text binary, extra binary"


def _chunks(chunk_bytes: int = CHUNK_BYTES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        held: list[tuple[int | None, bytes]] = []
        size, rows = 0, []  # rows: Arrow slices of the rows' other columns

        def flush():
            text = np.frombuffer(b"".join(t for _, t in held), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in held], dtype=np.int64)])
            first, last, place = runs_of(text, offsets)
            # run starts as differences, the others relative to them: few distinct bytes, which compress
            runs = np.stack([np.diff(first, prepend=0), last - first, place - first]).astype("<i4")
            ranks = np.array([LAST if i is None else i for i, _ in held], "<i8")
            null = np.array([i is None for i, _ in held])
            row = [null.tobytes(), ranks.tobytes(), offsets.tobytes(), pack(runs.tobytes()), pack(text.tobytes()), pack(_ipc(rows))]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], [x.split()[0] for x in CHUNK.split(", ")])

        for b in batches:
            first = 0
            for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                t = (t or "").encode("utf-8", "surrogatepass")
                if held and size + len(t) > chunk_bytes:
                    rows.append(b.slice(first, k - first).select(["row"]))
                    yield flush()
                    held, size, rows, first = [], 0, [], k
                held.append((i, t))
                size += len(t)
            rows.append(b.slice(first).select(["row"]))
        if held:
            yield flush()

    return run


def _ipc(batches: list[pa.RecordBatch]) -> bytes:
    """Batches of one schema as an Arrow stream, in which every value keeps its type."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for b in batches:
            if b.num_rows:
                out.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in b.columns], schema=b.schema))
    return sink.getvalue().to_pybytes()


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time: a chunk is large, and a batch has many."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


class Chunk:
    def __init__(self, row: dict):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        self.null = np.frombuffer(row["ids"], bool)
        self.ranks = np.frombuffer(row["ranks"], "<i8")
        self.offsets = np.frombuffer(row["offsets"], "<i8")
        self.text = np.frombuffer(unpack(row["text"]), np.uint8)
        runs = np.frombuffer(unpack(row["runs"]), "<i4").reshape(3, -1).astype(np.int64)
        self.first = np.cumsum(runs[0])
        self.last, self.place = self.first + runs[1], self.first + runs[2]
        self.doc = np.searchsorted(self.offsets, self.first, "right") - 1
        self.sums = sums(self.text)

        self.row = row

    def extra(self) -> pa.Array:
        """The rows' other columns, as structs."""
        import zstandard

        return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(self.row["extra"])).read_all().column("row").combine_chunks()

    def anchors(self) -> np.ndarray:
        return hash_at(self.sums, self.place, self.place + K) if len(self.place) else np.zeros(0, np.uint64)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of an anchor. Anchors have small hashes by their choice, so the hash is mixed anew."""
    return (((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


# -- anchors in two documents --------------------------------------------------


def _grouped(chunks: Iterator[pa.RecordBatch], one, group_bytes: int = GROUP_BYTES) -> Iterator[dict[int, list[tuple]]]:
    """What one(chunk row, chunk) yields, as (bucket, rest), by bucket, for chunks of about group_bytes of text at a time: a row for each chunk and bucket would be ever shorter as both grow in number."""
    held, size = {}, 0
    for b in chunks:
        for row in _rows(b):
            c = Chunk(row)
            size += len(c.text)
            for bucket, *rest in one(row, c):
                held.setdefault(bucket, []).append(rest)
            if size >= group_bytes:
                yield held
                held, size = {}, 0
    if held:
        yield held


ANCHORS = "bucket long, chunk binary, n binary, low binary, several binary, texts binary"


def _emit_anchors(buckets: int):
    def one(row, c):
        h = c.anchors()
        key = _bucket(h, buckets).astype(np.uint64) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
        text = hash_at(c.sums, c.first, c.last + WINDOW) ^ (c.last - c.first).astype(np.uint64) if len(h) else h
        order = np.lexsort((text, key))
        key, text, rank = key[order], text[order], c.ranks[c.doc][order] if len(h) else h
        head = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        new = np.flatnonzero(head)
        several = np.minimum.reduceat(rank, new) != np.maximum.reduceat(rank, new) if len(new) else np.zeros(0, bool)
        texts = np.add.reduceat(head | np.concatenate([[True], text[1:] != text[:-1]])[: len(key)], new, dtype=np.int64) if len(new) else new
        texts = np.minimum(texts, 65535).astype("<u2")
        key = key[new]
        of = (key >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
        low = key.astype("<u4")
        bounds = np.concatenate([cuts, [len(of)]])
        for x, y in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            yield int(of[x]), row["chunk"], low[x:y], several[x:y], texts[x:y]

    def run(batches):
        for held in _grouped(batches, one):
            rows = []
            for bucket, found in held.items():
                chunk, low, several, texts = zip(*found, strict=True)
                n = np.array([len(x) for x in low], "<i4")
                rows.append((bucket, np.array(chunk, "<i8").tobytes(), n.tobytes(), np.concatenate(low).tobytes(), np.packbits(np.concatenate(several)).tobytes(), np.concatenate(texts).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 5), strict=True)], [x.split()[0] for x in ANCHORS.split(", ")])

    return run


def _in_two(hot_texts: int = HOT_TEXTS):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a bucket, each chunk's fingerprints that are in two documents, and whether they have more than hot_texts texts."""
        blocks = [np.frombuffer(x, "<u4") for x in pdf["low"]]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(n)].astype(bool) for x, n in zip(pdf["several"], blocks, strict=True)]
        every, flag = np.concatenate(blocks), np.concatenate(flags)
        chunk, n = np.frombuffer(b"".join(pdf["chunk"]), "<i8").tolist(), np.frombuffer(b"".join(pdf["n"]), "<i4")
        order = np.argsort(every, kind="stable")
        s = every[order]
        heads = np.concatenate([[True], s[1:] != s[:-1]])
        group = np.cumsum(heads) - 1
        number = np.concatenate([np.frombuffer(x, "<u2") for x in pdf["texts"]]).astype(np.float64)
        times, texts = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
        times[order] = np.bincount(group)[group]
        texts[order] = np.bincount(group, number[order])[group]
        found = (times > 1) | flag
        cuts = np.cumsum(n)[:-1]
        out = [(c, low[f], t[f] > hot_texts) for c, low, f, t in zip(chunk, *(np.split(x, cuts) for x in (every, found, texts)), strict=True) if f.any()]
        return pd.DataFrame({"chunk": [x[0] for x in out], "bucket": [key[0]] * len(out), "low": [x[1].tobytes() for x in out], "hot": [x[2].tobytes() for x in out]})

    return run


# -- texts of runs ---------------------------------------------------------------


def _distinct_runs(c: Chunk, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the given runs: (representative run of each distinct text, place of each run's text among them). Equal texts are found by hash and compared byte by byte with their representative; a run that differs from it stands for itself."""
    first, end = c.first[which], c.last[which] + WINDOW
    h = hash_at(c.sums, first, end) ^ (end - first).astype(np.uint64)
    _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    size = end - first
    rep = at[inverse]
    differ = size != size[rep]
    for o in range(0, int(size.max()) if len(size) else 0):
        inside = o < size
        i, j = np.minimum(first + o, len(c.text) - 1), np.minimum(first[rep] + o, len(c.text) - 1)
        differ |= inside & (c.text[i] != c.text[j])
    if differ.any():
        rep = np.where(differ, np.arange(len(which)), rep)
    chosen, inverse = np.unique(rep, return_inverse=True)
    return which[chosen], inverse


TEXTS = "bucket long, chunk binary, n binary, run binary, at binary, rank binary, size binary, text binary"


def _marked(c: Chunk, buckets: int, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the runs whose anchor is in two documents, and whether it is a hot one."""
    wanted, hot = _wanted(row)
    h = c.anchors()
    key = _bucket(h, buckets).astype(np.uint64) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
    which = np.flatnonzero(np.isin(key, wanted))
    return which, np.isin(key[which], wanted[hot])


def _wanted(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and low bits in one number, and the hot marks."""
    parts = [np.uint64(b) << np.uint64(32) | np.frombuffer(x, "<u4").astype(np.uint64) for b, x in zip(row["buckets"] or [], row["lows"] or [], strict=True)]
    return (np.concatenate(parts), np.concatenate([np.frombuffer(x, bool) for x in row["hots"]])) if parts else (np.zeros(0, np.uint64), np.zeros(0, bool))


def _emit_texts(buckets: int):
    def one(row, c):
        which, hot = _marked(c, buckets, row)
        if not len(which):
            return
        reps, inverse = _distinct_runs(c, which)
        rank = np.full(len(reps), LAST)
        np.minimum.at(rank, inverse, c.ranks[c.doc[which]])
        hot = hot[np.searchsorted(which, reps)]
        of = _bucket(hash_at(c.sums, c.place[reps], c.place[reps] + K), buckets)
        size = c.last[reps] + WINDOW - c.first[reps]
        at = np.zeros(len(reps), np.int64)
        if hot.any():  # each string of a hot run on its own, dealt by its own hash
            n = np.where(hot, size - WINDOW + 1, 1)
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            reps, rank, of, size, hot = (np.repeat(x, n) for x in (reps, rank, of, size, hot))
            at, size = np.where(hot, inner, 0), np.where(hot, WINDOW, size)
            start = c.first[reps] + at
            of = np.where(hot, _bucket(hash_at(c.sums, start, start + WINDOW), buckets), of)
        order = np.argsort(of, kind="stable")
        reps, rank, of, at, size = (x[order] for x in (reps, rank, of, at, size))
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = c.text[np.repeat(c.first[reps] + at - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]]).tolist()
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield int(of[i]), row["chunk"], j - i, reps[i:j].astype("<i4").tobytes(), at[i:j].astype("<i2").tobytes(), rank[i:j].astype("<i8").tobytes(), size[i:j].astype("<i4").tobytes(), flat[ends[i] : ends[j]]

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for held in _grouped(batches, one):
            rows = []
            for bucket, found in held.items():
                chunk, n, *data = zip(*found, strict=True)
                rows.append((bucket, np.array(chunk, "<i8").tobytes(), np.array(n, "<i4").tobytes(), *(pack(b"".join(x)) for x in data)))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 7), strict=True)], [x.split()[0] for x in TEXTS.split(", ")])

    return run


# -- transforms --------------------------------------------------------------------


def transform(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of a shard of strings, each with an end marker (0; bytes are raised by 1), and its suffix array as (position in the marked concatenation). Suffixes are ordered by prefix doubling up to WINDOW bytes; equal prefixes keep the order of their positions."""
    size = np.array([len(t) for t in texts])
    n = int(size.sum()) + len(texts)
    symbols = np.zeros(n, np.int64)
    ends = np.cumsum(size + 1) - 1
    body = np.ones(n, bool)
    body[ends] = False
    symbols[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    left = np.repeat(ends, size + 1) - np.arange(n)  # symbols before the end marker
    key, span = symbols.copy(), 7  # symbols have 9 bits: the first 7 fit one number
    for k in range(1, span):
        key <<= 9
        key[:-k] |= np.where(left[:-k] >= k, symbols[k:], 0)
    order = np.argsort(key, kind="stable")
    k = key[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).astype(np.int64)]))
    while span < WINDOW:
        far = np.minimum(np.arange(n) + span, n - 1)
        second = np.where(left >= span, rank[far], 0)
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).astype(np.int64)]))
        span *= 2
    before = order - 1
    last = np.where((order == 0) | np.isin(before, ends), 0, symbols[np.maximum(before, 0)])
    return last.astype(np.uint16), order


def _bytes_if_few(x: np.ndarray) -> np.ndarray:
    """Numbers with the same order in the narrowest type that holds as many distinct values: a stable sort of 8 or 16 bits is one or two counting passes, of wider types a merge sort."""
    seen = np.zeros(int(x.max(initial=0)) + 1, bool)
    seen[x] = True
    code = np.cumsum(seen) - 1
    return code.astype(np.min_scalar_type(int(code[-1])))[x]


def interleave(transforms: list[np.ndarray], depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms by interleave refinement. Returns (shard of each place of the merged transform, first round whose prefixes differ from the place before: the common prefix of two neighbours is one less; 0 where they agree up to `depth`).

    Round h places, for every suffix in the order of round h - 1, the suffix that starts one symbol earlier: a
    stable counting sort by the transform's symbol. Strings' first suffixes, whose symbol is the end marker, come
    first. A boundary between two suffixes at round h - 1 parts their predecessors with an equal symbol at round h.
    """
    sizes = [len(t) for t in transforms]
    n = sum(sizes)
    shard = np.repeat(np.arange(len(transforms), dtype=np.min_scalar_type(max(0, len(transforms) - 1))), sizes)
    parted = np.zeros(n, np.int16)  # round in which a boundary before the place appeared
    group = np.zeros(n, np.int32 if n < 1 << 31 else np.int64)
    flat = _bytes_if_few(np.concatenate(transforms)) if n else np.zeros(0, np.uint16)
    for h in range(1, depth + 1):
        # the symbol at each place of the present interleave, taken from its shard in that shard's order
        by_shard = np.argsort(shard, kind="stable")
        symbol = np.empty(n, flat.dtype)
        symbol[by_shard] = flat
        order = np.argsort(symbol, kind="stable")
        moved, s, g = shard[order], symbol[order], group[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (g[1:] != g[:-1])]) if n else np.zeros(0, bool)
        parted_now = np.where(new & (parted == 0), h, parted).astype(np.int16)
        settled = h > 1 and np.array_equal(moved, shard) and np.array_equal(parted_now, parted)
        shard, parted, group = moved, parted_now, np.cumsum(new, dtype=group.dtype)
        if settled:
            break
    return shard, parted


def intervals(shards: list[list[bytes]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each shard, the interval number of the suffix at every position of its marked concatenation, and positions of its strings. Suffixes share an interval if their common prefix has at least WINDOW bytes (or both end earlier with equal text)."""
    built = [transform(t) for t in shards]
    shard, parted = interleave([b[0] for b in built])
    number = np.cumsum(parted > 0)
    out, places = [], []
    for k, (_, order) in enumerate(built):
        of = np.empty(len(order), np.int64)
        of[order] = number[shard == k]
        out.append(of)
        places.append(np.concatenate([[0], np.cumsum([len(t) + 1 for t in shards[k]])[:-1]]).astype(np.int64))
    return out, places


LEAST = "chunk long, run binary, at binary, rank binary"
#: Shards (transforms) that a batch of texts is merged from, and texts in a batch.
SHARDS, BATCH = 4, 8000


def _sharing(texts: list[bytes]) -> list[np.ndarray]:
    """Places of the texts that share a string with another one by its hash, in batches that hold all texts that share with each other (a batch is only larger than BATCH if they are linked)."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    w = size - WINDOW + 1
    own = np.repeat(np.arange(len(texts)), w)
    at = np.repeat(np.cumsum(size) - size, w) + np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
    h = hash_at(sums(flat), at, at + WINDOW)
    order = np.argsort(h, kind="stable")
    h, own = h[order], own[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (own[1:] != own[:-1]))
    a, b = own[same], own[same + 1]
    root = np.arange(len(texts))
    while True:  # least members of linked texts
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = np.minimum(low, low[low])
        if np.array_equal(low, root):
            break
        root = low
    which = np.unique(np.concatenate([a, b]))
    which = which[np.argsort(root[which], kind="stable")]
    heads = np.flatnonzero(np.concatenate([[True], root[which][1:] != root[which][:-1]])) if len(which) else np.zeros(0, np.int64)
    out, start = [], 0
    for end in [*heads[1:].tolist(), len(which)]:
        if end - start >= BATCH or end == len(which):
            out.append(which[start:end])
            start = end
    return [x for x in out if len(x)]


def _least(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """The least document of every string of the bucket's texts. Per chunk: arrays (run, string's place from the run's start where the least document changes, its rank)."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    texts: list[bytes] = []
    runs, offsets, ranks, chunks = [], [], [], []
    for c, m, r, o, k, n, t in zip(pdf["chunk"], pdf["n"], pdf["run"], pdf["at"], pdf["rank"], pdf["size"], pdf["text"], strict=True):
        t, ends = unpack(t), np.cumsum(np.frombuffer(unpack(n), "<i4")).tolist()
        texts += [t[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        runs.append(np.frombuffer(unpack(r), "<i4").astype(np.int64))
        offsets.append(np.frombuffer(unpack(o), "<i2").astype(np.int64))
        ranks.append(np.frombuffer(unpack(k), "<i8"))
        chunks.append(np.repeat(np.frombuffer(c, "<i8"), np.frombuffer(m, "<i4")))
    run, offset, rank, chunk = map(np.concatenate, (runs, offsets, ranks, chunks))
    code, distinct = pd.factorize(np.array(texts, object))
    del texts
    n = len(distinct)
    least = np.full(n, LAST)
    np.minimum.at(least, code, rank)
    shard_of = np.zeros(n, np.int64)
    shard_of[code] = chunk % SHARDS
    windows = np.array([len(t) - WINDOW + 1 for t in distinct], np.int64)
    heads = np.concatenate([[0], np.cumsum(windows)])
    value = np.repeat(least, windows)
    # a text that shares no string with another distinct text keeps its own least document
    for merged in _sharing(list(distinct)):
        members = [merged[shard_of[merged] == s] for s in range(SHARDS)]
        members = [m for m in members if len(m)]
        numbers, places = intervals([[distinct[i] for i in m] for m in members])
        spot, which, doc = [], [], []
        for m, of, at in zip(members, numbers, places, strict=True):
            w = windows[m]
            inner = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            spot.append(np.repeat(heads[m], w) + inner)
            which.append(of[np.repeat(at, w) + inner])
            doc.append(np.repeat(least[m], w))
        spot, which, doc = map(np.concatenate, (spot, which, doc))
        low = np.full(int(which.max()) + 1, LAST)
        np.minimum.at(low, which, doc)
        value[spot] = low[which]
    change = np.concatenate([[True], value[1:] != value[:-1]])
    change[heads[:-1]] = True
    at = np.flatnonzero(change)
    text_of = np.searchsorted(heads, at, "right") - 1
    from_, count = np.searchsorted(text_of, np.arange(n)), np.bincount(text_of, minlength=n)
    out = []
    order = np.argsort(chunk, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
        t = code[part]
        c = count[t]
        pick = np.repeat(from_[t], c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        out.append((chunk[part[0]], np.repeat(run[part], c).astype("<i4").tobytes(), (np.repeat(offset[part], c) + at[pick] - heads[text_of[pick]]).astype("<i2").tobytes(), value[at[pick]].astype("<i8").tobytes()))
    return pd.DataFrame(out, columns=["chunk", "run", "at", "rank"])


# -- removal ---------------------------------------------------------------------------


def covered(c: Chunk, buckets: int, row: dict) -> np.ndarray:
    """Which bytes of a chunk are removed."""
    out = np.zeros(len(c.text) + 1, np.int32)
    which, _ = _marked(c, buckets, row)
    if not len(which):
        return out[:-1].astype(bool)
    reps, inverse = _distinct_runs(c, which)
    run = np.concatenate([np.frombuffer(x, "<i4") for x in row["run"]]).astype(np.int64)
    at = np.concatenate([np.frombuffer(x, "<i2") for x in row["at"]]).astype(np.int64)
    rank = np.concatenate([np.frombuffer(x, "<i8") for x in row["rank"]])
    order = np.lexsort((at, run))
    run, at, rank = run[order], at[order], rank[order]
    rep_run = reps[inverse]
    lo, hi = np.searchsorted(run, rep_run, "left"), np.searchsorted(run, rep_run, "right")
    count = hi - lo
    pick = np.repeat(lo, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    mine = np.repeat(which, count)
    end_of = np.where(np.concatenate([mine[1:] != mine[:-1], [True]]), c.last[mine] - c.first[mine], np.concatenate([at[pick][1:], [0]]) - 1) if len(pick) else pick
    gone = rank[pick] < c.ranks[c.doc[mine]]
    start, stop = c.first[mine] + at[pick], c.first[mine] + end_of + WINDOW
    np.add.at(out, start[gone], 1)
    np.add.at(out, stop[gone], -1)
    return np.cumsum(out[:-1]) > 0


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: With texts: the remaining text. The row's other columns follow.
TEXT = DIGEST + ", text string"


def _finish(buckets: int, with_text: bool):
    def run(batches):
        for b in batches:
            for row in _rows(b):
                c = Chunk(row)
                gone = covered(c, buckets, row)
                rows = []
                for k, (s, e) in enumerate(zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist(), strict=True)):
                    g = gone[s:e]
                    removed = int(g.sum())
                    kept = c.text[s:e][~g].tobytes() if removed else c.text[s:e].tobytes()
                    spans = int((np.diff(g.astype(np.int8), prepend=0) == 1).sum()) if removed else 0
                    rows.append((None if c.null[k] else int(c.ranks[k]), e - s, removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = [x.split()[0] for x in (TEXT if with_text else DIGEST).split(", ")]
                out = [pa.array(x, t) for x, t, _ in zip(cols, kinds, names, strict=False)]
                yield pa.RecordBatch.from_arrays([*out, c.extra()], [*names, "row"]) if with_text else pa.RecordBatch.from_arrays(out, names)

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False, chunk_bytes: int = CHUNK_BYTES, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the remaining text, and the other columns as the struct row) of every row of docs (doc_id, text).

    Null text: as empty. Texts below WINDOW bytes keep everything. A null doc_id ranks after every other, so its
    rows lose what others have and take nothing from them. Rows that repeat a doc_id are judged one by one against
    smaller ids only. Empty table: empty result. Chunks, buckets and what returns to a chunk have a bounded size or
    one bounded by a chunk's; texts that repeat in a chunk leave it once, so a passage that a third of all documents
    hold is one row a chunk. With with_text, bytes of a character that is cut in two are left out of the text.
    """
    others = [x for x in docs.columns if x not in ("doc_id", "text")] if with_text else []
    row = F.struct(*[F.col(f"`{x}`") for x in others]) if others else F.lit(0)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row.alias("row"))
    chunks = rows.mapInArrow(lean(_chunks(chunk_bytes)), CHUNK)
    chunks = bucketed(chunks.select("*", F.monotonically_increasing_id().alias("chunk")), "chunk")
    buckets = max(64, chunks.count() * chunk_bytes // BUCKET_BYTES)
    anchors = chunks.mapInArrow(lean(_emit_anchors(buckets)), ANCHORS)
    shared = persisted(anchors.groupBy("bucket").applyInPandas(lean_group(_in_two(hot_texts)), "chunk long, bucket long, low binary, hot binary"))
    wanted = shared.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "low", "hot")).alias("w")).select("chunk", F.col("w.bucket").alias("buckets"), F.col("w.low").alias("lows"), F.col("w.hot").alias("hots"))
    marked = chunks.join(wanted.hint("shuffle_hash"), "chunk", "left")  # the large side stays in its buckets, unsorted
    texts = marked.mapInArrow(lean(_emit_texts(buckets)), TEXTS)
    least = persisted(texts.groupBy("bucket").applyInPandas(lean_group(_least), LEAST))
    back = least.groupBy("chunk").agg(F.collect_list(F.struct("run", "at", "rank")).alias("b")).select("chunk", F.col("b.run").alias("run"), F.col("b.at").alias("at"), F.col("b.rank").alias("rank"))
    return marked.join(back.hint("shuffle_hash"), "chunk", "left").mapInArrow(lean(_finish(buckets, with_text)), StructType.fromDDL(TEXT).add("row", rows.schema["row"].dataType) if with_text else DIGEST)


def strip_repeats(docs: DataFrame) -> DataFrame:
    """docs, columns as they were, with the text that remove_repeats leaves (a null text becomes empty); n_chars, where there is one, follows. The other columns, whatever their names and types, travel with their row as Arrow values, so nothing is joined by doc_id. Null ids, repeated rows and empty tables as in remove_repeats."""
    out = remove_repeats(docs, with_text=True)
    columns = []
    for f in docs.schema.fields:
        if f.name == "n_chars":
            columns.append(F.length("text").cast(f.dataType).alias("n_chars"))
        elif f.name in ("doc_id", "text"):
            columns.append(F.col(f.name).cast(f.dataType))
        else:
            columns.append(F.col(f"row.`{f.name}`").alias(f.name))
    return out.select(*columns)
