"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Of at most 4 differing bits, the two segments
with the fewest errors hold at most 2 together, so some pair of segments differs by at most 2 bits in each. Each
segment, padded to 23 bits, is decoded by the perfect binary Golay code: a word has the index of the codeword
within distance 3 as its key and, where that distance is 3, also the indices of the five codewords at distance 4.
Two words at distance 2 or less always share a key (checked over all coset leaders in the tests). Keys of a pair
of segments, with the pair's number, are the blocking keys; fingerprints that meet in one are verified.

Four bits of 64 are a similarity of about 0.96. For lower ones (similar_texts, 0.8 of five-word shingles as a rule)
the links so found are followed by those of a prefix filter, which misses none, and the exact Jaccard similarity
decides each. Links leave their task as a spanning forest, so their number is linear in the rows; a common
element's rows and a large group of candidates are dealt before one task has them all.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.overlap import MOST_SAME, SLICE_BYTES, alike, digest_of, meet, node_of, odd_sketch
from .common import bucketed, connected_components, discard, join_sized, lean, persisted

#: Fixed: generator polynomial of the binary Golay code (23, 12, 7).
GENERATOR = 0b110001110101
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift, width
MOST_BITS = 4
WORDS_A_SHINGLE, SEED = 4, 42
#: Fingerprints of one key that are compared in one go; a key with more is dealt to cells of blocks.
MOST_RUN = 4096
#: Similar texts: sets in the sample that orders shingles, least hashes of each, and shingles that so get a place behind the others.
SAMPLE, SAMPLE_HASHES, COMMON = 8000, 512, 100_000
#: Shingles of a group of candidates that one task compares; members that all of a larger group meet first; parts of a very common element's rows.
MOST_SHINGLES, PIVOTS, SALTS = 1_000_000, 3, 64
WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall


def shingle_hashes(text: str | None, words_a_shingle: int = WORDS_A_SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; of the whole sequence if it has fewer words; none without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = WORDS((text or "").encode("utf-8", "surrogatepass").lower())  # bytes.lower is A-Z only
    line, k = b" ".join(words), words_a_shingle
    if len(words) <= k:
        return np.array([digest(line, seed)] * bool(words), "<u8")
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[k - 1 :], strict=False)], "<u8")


def majority(h: np.ndarray) -> int:
    """The fingerprint over hashes. A bit is 1 if it is set in over half of them."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):  # blocks keep the unpacked bits small, however long the text
        x = np.ascontiguousarray(h[i : i + 4096, None])
        votes += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words_a_shingle: int = WORDS_A_SHINGLE, seed: int = SEED) -> int:
    """SimHash over the XXH64 of word shingles, repeats included; 0 without words. A bit is 1 if it is set in over half of the hashes."""
    return majority(shingle_hashes(text, words_a_shingle, seed))


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of 12 high and 11 low bits folded to one table of 2^23 is avoided: (remainder of each high part, [syndrome, 6] vectors of the coset that lead to key codewords, number of keys of the syndrome)."""

    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    high = np.array([remainder(m << 11) for m in range(4096)], np.uint32)
    unit = [remainder(1 << i) for i in range(23)]
    vectors, keys = np.zeros((2048, 6), np.uint32), np.ones(2048, np.int8)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            s = v = 0
            for b in bits:
                s ^= unit[b]
                v |= 1 << b
            vectors[s] = v
            if weight == 3:
                keys[s] = 6
    fill = np.ones(2048, np.int8)
    for bits in combinations(range(23), 4):
        s = v = 0
        for b in bits:
            s ^= unit[b]
            v |= 1 << b
        if keys[s] == 6:
            vectors[s, fill[s]] = v
            fill[s] += 1
    return high, vectors, keys


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([n, 6] codeword indices, number of valid ones) of 23-bit words."""
    high, vectors, keys = golay_tables()
    words = words.astype(np.uint32)
    syndrome = high[words >> 11] ^ (words & 2047)
    return ((words[:, None] ^ vectors[syndrome]) >> 11).astype(np.int64), keys[syndrome]


def blocking_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place of the fingerprint) for all keys of all pairs of segments."""
    parts = [segment_keys((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)) for shift, width in SEGMENTS]
    keys, places = [], []
    six = np.arange(6)
    for number, (i, j) in enumerate(combinations(range(len(parts)), 2)):
        (a, na), (b, nb) = parts[i], parts[j]
        key = (number << 24) | (a[:, :, None] << 12) | b[:, None, :]
        valid = (six[None, :, None] < na[:, None, None]) & (six[None, None, :] < nb[:, None, None])
        keys.append(key[valid])
        places.append(np.broadcast_to(np.arange(len(fps))[:, None, None], valid.shape)[valid])
    return np.concatenate(keys), np.concatenate(places)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(fps), 2000):
            block = fps[i : i + 2000]
            keys, places = blocking_keys(block)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(block[places].view(np.int64))], ["key", "fp"])


def forest(fps: np.ndarray, most: int = MOST_BITS) -> Iterator[tuple[int, np.ndarray]]:
    """(fingerprint, those linked to it) over a spanning forest of the links within fps. Each step compares one fingerprint with those not yet reached, so a dense group costs little more than its size."""
    rest = fps
    queue: list = []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        x = queue.pop()
        near = np.bitwise_count(rest ^ x) <= most
        if near.any():
            found = rest[near]
            yield x, found
            queue.extend(found)
            rest = rest[~near]


def _link(columns: int, most_run: int | None, most: int, tree):
    """Over batches sorted by their first `columns` columns (the last column is the fingerprint): rows (kind, a, b), kind 0 a link, kind 1 a row of a key with over most_run rows, to be dealt again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_key, held_n, passing = None, 0, False

        def rows(kind, a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.uint64).view(np.int64) if kind == 0 else a), pa.array(b.astype(np.uint64).view(np.int64))], ["kind", "a", "b"])

        def done():
            if held_n > 1:
                if pairs := list(tree(np.unique(np.concatenate(held)), most)):
                    yield rows(0, np.concatenate([np.full(len(found), x, np.uint64) for x, found in pairs]), np.concatenate([found for _, found in pairs]))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(columns)])
            fps = batch.column(columns).to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [len(fps)]])
            # runs of up to 8 that lie inside the batch: compared place by place
            sizes = np.diff(starts)
            inner = np.zeros(len(sizes), bool)
            inner[1:-1] = sizes[1:-1] <= 8
            size_of = np.repeat(np.where(inner, sizes, 0), sizes)
            run_of = np.repeat(np.arange(len(sizes)), sizes)
            for shift in range(1, 8):
                if (ok := (size_of[:-shift] > shift) & (run_of[:-shift] == run_of[shift:])).any():
                    at = np.flatnonzero(ok)
                    a, b = fps[at], fps[at + shift]
                    near = (np.bitwise_count(a ^ b) <= most) & (a != b)
                    if near.any():
                        yield rows(0, a[near], b[near])
            for r in np.flatnonzero(~inner):
                s, e = starts[r], starts[r + 1]
                key = tuple(keys[:, s])
                if key != held_key:
                    if not passing:
                        yield from done()
                    held, held_key, held_n, passing = [], key, 0, False
                if passing:
                    yield rows(1, np.full(e - s, key[0]), fps[s:e])
                    continue
                held.append(fps[s:e].copy())
                held_n += e - s
                if most_run and held_n > most_run:
                    every = np.concatenate(held)
                    yield rows(1, np.full(len(every), key[0]), every)
                    held, passing = [], True
        if not passing:
            yield from done()

    return run


def links(fps: DataFrame, most_run: int = MOST_RUN, column: str = "fp", emit=_emit_keys, most: int = MOST_BITS, tree=forest) -> DataFrame:
    """(src, dst): a spanning forest's links, at most `most` bits apart, of the groups of distinct fingerprints. emit turns the column into keys and fingerprints. Links inside a key's run are reduced to a forest before they leave the task; a key with too many fingerprints is dealt to cells, one for each pair of its blocks, so that every pair still meets."""
    out = "kind int, a long, b long"
    keys = fps.select(column).mapInArrow(lean(emit), "key long, fp long").repartition("key").sortWithinPartitions("key")
    first = persisted(keys.mapInArrow(lean(_link(1, most_run, most, tree)), out))
    found = first.where("kind = 0")
    hot = first.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if not hot.isEmpty():
        blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / F.lit(most_run / 2)).cast("int").alias("n"))
        cells = join_sized(hot, blocks, "key", "inner", 16).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")))
        cells = cells.select("key", "own", "fp", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
        cells = cells.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
        found = found.unionByName(cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lean(_link(3, None, most, tree)), out))
    return found.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and group of every row of docs (doc_id, text).

    Null or wordless text: fingerprint zero, linked like any other. component_id is the smallest doc_id reachable
    (nulls are passed over; null if the group has no other id); group numbers the component. Repeated rows give a
    row each and share a fingerprint. Empty table: empty result. Whole texts are read once; equal fingerprints meet
    by an aggregation with map-side combining before any are compared.
    """

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    rows = persisted(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, fp long"))
    distinct = persisted(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = _grouped(rows, distinct, links(distinct))
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "group")


def _grouped(rows: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (with fp) with the group of their fingerprint and the group's component_id, the smallest doc_id."""
    members = connected_components(edges)
    grouped = distinct.join(members, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    least = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    return join_sized(rows, grouped.select("fp", "group").join(least, "group"), "fp", "left", 24)


# -- texts at a Jaccard similarity ---------------------------------------------------


def shingle_set(text: str | None, words_a_shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words_a_shingle))


def prefix(h: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """So many of the first hashes, in one order for all sets (rare in the sample first, then by value), that sets at the similarity or more have one of them in common."""
    if not len(h):
        return h
    most = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
    often = np.zeros(len(h), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        often = np.where(common[at] == h, counts[at], 0)
    return h[np.lexsort((h, often))[:most]]


def _sign(words_a_shingle: int, share: float):
    """Of (text, th, doc_id): a set's digest, size, fingerprint and sketch; of a share of the rows also its least hashes, for the sample."""

    def run(batches):
        for b in batches:
            rows = []
            for text, doc_id in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                h = shingle_set(text, words_a_shingle)
                digest = digest_of(h)
                taken = zlib.crc32(digest + str(doc_id).encode()) < share * 2**32
                rows.append((digest, node_of(digest), len(h), np.uint64(majority(h)).astype(np.int64), odd_sketch(h), h[:SAMPLE_HASHES].view(np.int64) if taken else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["th", "doc_id", *(x.split()[0] for x in SIGNED.split(", ")[2:])])

    return run


SIGNED = "th long, doc_id long, digest binary, node long, size long, fp long, odd binary, sample array<long>"


def _prefixes(similarity: float, words_a_shingle: int, common: np.ndarray, counts: np.ndarray, salts: int):
    """(key, salt, node, at) for the prefix of every set that the task hasn't met before. Keys that a hundredth of the sample or more has are salted."""

    def run(batches):
        seen: set[bytes] = set()
        hot = common[counts >= max(2, SAMPLE // 100)]
        for b in batches:
            held = []
            for text in b.column(0).to_pylist():
                h = shingle_set(text, words_a_shingle)
                digest = digest_of(h)
                if digest in seen:
                    continue
                seen.add(digest)
                key, node = prefix(h, similarity, common, counts), node_of(digest)
                salt = np.where(np.isin(key, hot), 1 + node % salts, 0) if len(hot) else np.zeros(len(key), np.int64)
                held.append((key.view(np.int64), salt, np.full(len(key), node, np.int64), len(h) << 32 | np.arange(len(key))))
            if held:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2]), pa.array(cols[3].astype(np.int64))], ["key", "salt", "node", "at"])

    return run


class Family:
    """Sets of one task that are compared exactly: roots (which are linked already) and the links found."""

    def __init__(self, sets: list[np.ndarray], roots: list, similarity: float):
        flat = np.concatenate(sets) if sets else np.zeros(0, "<u8")
        self.sizes = np.array([len(h) for h in sets], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        names, self.codes = np.unique(flat, return_inverse=True)
        self.mark = np.zeros(len(names) + 1, bool)
        self.root = np.array(roots, np.int64)
        self.similarity = similarity

    def near(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of the places `others` whose Jaccard similarity with place x is at least that asked for."""
        n = self.sizes[x]
        others = others[(self.sizes[others] >= self.similarity * n - 1e-6) & (n >= self.similarity * self.sizes[others] - 1e-6)]
        own = self.codes[self.starts[x] : self.starts[x] + n]
        self.mark[own] = True
        inner = np.empty(len(others), np.int64)
        for i in range(0, len(others), 512):
            some = others[i : i + 512]
            size = self.sizes[some]
            ends = np.cumsum(size)
            at = np.repeat(self.starts[some] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
            inner[i : i + 512] = np.add.reduceat(self.mark[self.codes[at]].astype(np.int64), ends - size) if len(at) else 0
        self.mark[own] = False
        return others[inner >= self.similarity * (n + self.sizes[others] - inner) - 1e-9]

    def links(self, searchers: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links that join places of different roots, enough to span all links of the searchers."""
        left = len(np.unique(self.root))
        for x in searchers.tolist():
            if left < 2:
                return
            for y in self.near(x, np.flatnonzero(self.root != self.root[x])).tolist():
                if self.root[y] != self.root[x]:
                    yield x, y
                    self.root[self.root == self.root[y]] = self.root[x]
                    left -= 1


CANDIDATE = "group long, i int, b int, id long, root long, searcher boolean, digest binary, z binary"


def _verify(similarity: float, words_a_shingle: int):
    """Over CANDIDATE rows sorted by cell (group, i, b) and id: exact links (src, dst)."""

    def links(rows):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        sets, ids, roots, searchers = [], [], [], []
        for id_, root, searcher, digest, z in rows:
            if ids and ids[-1] == id_ and searchers[-1] >= searcher:
                continue  # copies of one text
            h = shingle_set(unpack(z).decode("utf-8", "surrogatepass"), words_a_shingle)
            if digest_of(h) == digest:
                sets.append(h)
                ids.append(id_)
                roots.append(root)
                searchers.append(searcher)
        family = Family(sets, roots, similarity)
        found = list(family.links(np.flatnonzero(np.array(searchers, bool))))
        if found:
            src, dst = np.array(ids, np.int64)[np.array(found).T]
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    def run(batches):
        held, cell = [], None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:3] != cell:
                    if len(held) > 1:
                        yield from links(held)
                    held, cell = [], row[:3]
                held.append(row[3:])
        if len(held) > 1:
            yield from links(held)

    return run


def _against_pivots(similarity: float, words_a_shingle: int):
    """Over rows (group, part, kind, id, digest, z) sorted by the first three, a group's pivots (kind 0) before its members: (id, pivot) for each pivot that a member is similar to, pivot null if there is none."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        cell, pivots = None, []
        for b in batches:
            out = []
            for group, part, kind, id_, digest, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = shingle_set(unpack(z).decode("utf-8", "surrogatepass"), words_a_shingle)
                if digest_of(h) != digest:
                    continue
                if cell != (group, part):
                    cell, pivots = (group, part), []
                if kind == 0:
                    pivots.append((id_, h))
                    continue
                inner = [len(h) + len(s) - len(np.union1d(h, s)) for _, s in pivots]
                near = [p for (p, s), n in zip(pivots, inner, strict=True) if n >= similarity * (len(h) + len(s) - n) - 1e-9]
                out += [(id_, p) for p in near] or [(id_, None)]
            cols = list(zip(*out, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], ["id", "pivot"])

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, id, digest, z) of (text, th, group, id, digest), once for each id that the task meets."""
    import zstandard

    pack, seen = zstandard.ZstdCompressor(level=3).compress, set()
    for b in batches:
        new = []
        for i, x in enumerate(b.column("id").to_pylist()):
            if (key := (x, b.column("th")[i].as_py())) not in seen:
                seen.add(key)
                new.append(i)
        b = b.take(pa.array(new, pa.int64()))
        z = pa.array([pack((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("group"), b.column("id"), b.column("digest"), z], ["group", "id", "digest", "z"])


def _verified(docs: DataFrame, nodes: DataFrame, groups: DataFrame, similarity: float, words_a_shingle: int, most_shingles: int, pivots: int) -> DataFrame:
    """Exact links (src, dst) that span all links between nodes of a group of candidates.

    A candidate's text goes to its group once. A group of over most_shingles is compared with `pivots` of its members
    first; what isn't similar to one of them meets all others in cells, block by block.
    """
    of = persisted(join_sized(nodes.select("id", "node", "th", "digest", "size"), groups, "node", "inner", 16).select("id", "th", "digest", "size", F.col("component").alias("group")))
    weights = persisted(of.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("weight")).where("n > 1"))
    of = join_sized(of, weights, "group", "inner", 32).select("th", "group", "id", "digest")
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    texts = persisted(join_sized(rows, of, "th", "inner", 48).select("text", "th", "group", "id", "digest").mapInArrow(lean(_texts), "group long, id long, digest binary, z binary"))
    large = weights.where(F.col("weight") > most_shingles)
    flat = join_sized(texts, large.select("group"), "group", "left_anti", 8)
    flat = flat.select("group", F.lit(0).alias("i"), F.lit(0).alias("b"), "id", F.col("id").alias("root"), F.lit(True).alias("searcher"), "digest", "z")
    check = lean(_verify(similarity, words_a_shingle))
    found = flat.repartition("group").sortWithinPartitions("group", "i", "b", "id").mapInArrow(check, "src long, dst long")
    if large.isEmpty():
        return found
    hot = join_sized(texts, large, "group", "inner", 32)
    picked = hot.groupBy("group").agg(F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("id", F.lit(k)), "id"))["id"] for k in range(pivots)])).alias("p")).select("group", F.explode("p").alias("id"))
    picked = persisted(join_sized(hot, picked, ["group", "id"], "left_semi", 16).groupBy("group", "id").agg(*[F.min(c).alias(c) for c in ("digest", "z", "weight")]))
    parts = F.ceil(F.col("weight") / most_shingles).cast("int")
    pivot_rows = picked.select("group", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("kind"), "id", "digest", "z")
    members = hot.select("group", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(1).alias("kind"), "id", "digest", "z")
    met = pivot_rows.unionByName(members).repartition("group", "part").sortWithinPartitions("group", "part", "kind", "id")
    star = persisted(met.mapInArrow(lean(_against_pivots(similarity, words_a_shingle)), "id long, pivot long").distinct())
    found = persisted(found.unionByName(star.where("pivot is not null and pivot != id").select(F.col("id").alias("src"), F.col("pivot").alias("dst"))))
    rest = star.where("pivot is null").select("id")
    if rest.isEmpty():
        return found
    roots = star.groupBy("id").agg(F.min("pivot").alias("root"))
    every = persisted(hot.join(roots, "id").select("group", "id", "digest", "z", F.coalesce("root", "id").alias("root"), F.ceil(F.col("weight") / most_shingles).cast("int").alias("blocks"), F.col("root").isNull().alias("rest"), (F.col("weight") / F.col("n") / most_shingles).alias("share")))
    counts = every.where("rest").groupBy("group").agg(F.ceil(F.sum("share")).cast("int").alias("slices"))
    every = every.join(counts, "group")
    block, part = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("slices")).cast("int")
    targets = every.withColumn("b", block).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    searchers = every.where("rest").withColumn("i", part).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = targets.withColumn("searcher", F.lit(False)).unionByName(searchers.withColumn("searcher", F.lit(True)))
    cells = cells.select("group", "i", "b", "id", "root", "searcher", "digest", "z").repartition("group", "i", "b").sortWithinPartitions("group", "i", "b", "id", F.desc("searcher"))
    return found.unionByName(cells.mapInArrow(check, "src long, dst long"))


def _similar(docs: DataFrame, similarity: float, words_a_shingle: int, most_run: int = MOST_SAME, most_shingles: int = MOST_SHINGLES, pivots: int = PIVOTS, salts: int = SALTS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(th, doc_id, group) of every row of docs; th: the hash of its text. See similar_texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    share = min(1.0, SAMPLE / max(1, docs.count()))
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("th"), F.col("doc_id").cast("long").alias("doc_id"))
    signed = persisted(rows.mapInArrow(lean(_sign(words_a_shingle, share)), SIGNED))
    nodes = signed.groupBy("digest").agg(F.min("th").alias("th"), *[F.first(c).alias(c) for c in ("node", "size", "fp", "odd")])
    nodes = bucketed(nodes.withColumn("id", F.monotonically_increasing_id()).repartition("node"), "node")

    # an order that puts what the sample has often last; any order finds all pairs
    several = persisted(signed.where("sample is not null").select(F.explode("sample").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(COMMON))
    taken = several.toArrow()
    common, counts = taken["h"].to_numpy().view("<u8"), taken["n"].to_numpy()
    common, counts = common[np.argsort(common)], counts[np.argsort(common)]
    discard(several)

    # candidates by the method: fingerprints at most MOST_BITS apart
    first = persisted(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")))
    equal = nodes.select("fp", F.col("node").alias("src")).join(first.where("n > 1"), "fp").where("src != node").select("src", F.col("node").alias("dst"))
    golay = links(first.select("fp"))
    for end in ("src", "dst"):
        golay = golay.join(first.select(F.col("fp").alias(end), F.col("node").alias(f"n_{end}")), end)
    golay = golay.select(F.col("n_src").alias("src"), F.col("n_dst").alias("dst"))

    # candidates by prefixes
    keys = rows.select("text").mapInArrow(lean(_prefixes(similarity, words_a_shingle, common, counts, salts)), "key long, salt int, node long, at long")
    met = persisted(keys.repartition("key", "salt").sortWithinPartitions("key", "salt", "node").mapInArrow(lean(meet(similarity, most_run)), "kind int, key long, node long, at long"))
    same = met.where("kind = 0").select(F.col("node").alias("src"), F.col("key").alias("dst"))
    near = alike(met, nodes, similarity, slice_bytes, persisted, lean)
    groups = connected_components(equal.unionByName(golay).unionByName(same).unionByName(near))
    discard(met, first)

    found = _verified(docs, nodes, groups, similarity, words_a_shingle, most_shingles, pivots)
    members = connected_components(found)
    grouped = join_sized(nodes.select("digest", "id"), members.select(F.col("node").alias("id"), "component"), "id", "left", 16).select("digest", F.coalesce("component", "id").alias("group"))
    return signed.select("th", "doc_id", "digest").join(grouped, "digest").select("th", "doc_id", "group")


def similar_texts(docs: DataFrame, similarity: float = 0.8, words_a_shingle: int = 5, **bounds: int) -> DataFrame:
    """doc_id, group and component_id of every row of docs (doc_id, text): texts whose sets of word shingles are similar.

    A link is a pair whose sets have a Jaccard similarity of at least `similarity`, computed for the pair; groups are
    the components of all links. Candidates are the links of the Golay keys of the sets' SimHash and, since Golay keys
    are certain for a few bits only, pairs that share an element of their prefixes and that neither sizes and places
    nor a bound on the sets' difference rule out; no pair at the similarity is missed. Candidates form groups, and the
    sets of a group are compared exactly. Null or wordless texts are one group. Null ids, repeated rows and empty
    tables as in near_duplicates. bounds: what one task takes at most, see _similar; they don't change the result.
    """
    rows = persisted(_similar(docs, similarity, words_a_shingle, **bounds))
    least = rows.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return join_sized(rows, least, "group", "left", 16).select("doc_id", "component_id", "group")


def keep_one(docs: DataFrame, similarity: float = 0.8, words_a_shingle: int = 5) -> DataFrame:
    """docs with one row of each group of similar texts: that of the smallest doc_id, nulls last; of rows with the same id the one whose text has the smallest hash, and of rows repeated in id and text any one. All columns, whatever their names, stay. Null texts count as empty; an empty table gives an empty result."""
    rows = _similar(docs, similarity, words_a_shingle)
    pairs = persisted(rows.groupBy("group", "doc_id", "th").agg(F.count("*").alias("n")))
    best = pairs.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th", "n")).alias("k"))
    judged = persisted(pairs.join(best, "group").select("doc_id", "th", "n", (F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("th") == F.col("k.th"))).alias("stays")))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("own_th"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_th") == F.col("th"))
    gone, twice = judged.where("not stays"), persisted(judged.where("stays and n > 1").select("doc_id", "th"))
    kept = join_sized(own, gone.select("doc_id", "th"), same, "left_anti", 16)
    if not twice.isEmpty():
        once = join_sized(kept, twice, same, "left_semi", 16).dropDuplicates(["own_id", "own_th"])
        kept = join_sized(kept, twice, same, "left_anti", 16).unionByName(once)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
