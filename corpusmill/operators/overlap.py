"""Candidates for a similarity of sets by shared elements of their prefixes, sizes, places and parity sketches.

Two sets of a Jaccard similarity share one of the first elements of both in any common order; where that is the first
that they share, sizes and places leave room for the rest, and sketches bound their difference. No pair is missed.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least and most bits of a set's sketch.
LEAST_SKETCH, MOST_SKETCH = 512, 8192
#: Sets that share an element and whose places are compared in one go (of more, all get their sketches), and those compared place by place.
MOST_SAME, SHORT_RUN = 2048, 8
#: Bytes of rows with sketches, for each shuffle partition, that are on disk at once: the keys are taken in so many slices.
SLICE_BYTES = 8 << 20


def digest_of(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def node_of(digest: bytes) -> int:
    """A set's name where candidates are gathered. Sets that share one are only compared once more."""
    return int.from_bytes(digest[:8], "little", signed=True)


def odd_sketch(h: np.ndarray) -> bytes:
    """A bit for each of 512, 1024, ... MOST_SKETCH places, as many as the set has elements or more: the parity of the hashes that fall on it. Two sets' sketches differ in no more bits than the sets differ in elements. Halves laid over each other (exclusive or) are the sketch of half as many bits."""
    bits = LEAST_SKETCH
    while bits < min(len(h), MOST_SKETCH):
        bits *= 2
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class Sketches:
    """Sketches of any lengths; two are compared at the length of the shorter one."""

    def __init__(self, sketches: list[bytes]):
        self.level = np.array([(len(x) * 8 // LEAST_SKETCH).bit_length() - 1 for x in sketches], np.int64)
        self.folded: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of each length: place in the matrix or -1, the places in it, the matrix
        longer = np.zeros((0, 0), np.uint64)
        for level in range(int(self.level.max(initial=0)), -1, -1):
            words = LEAST_SKETCH // 64 << level
            own = np.flatnonzero(self.level == level)
            half = longer[:, :words] ^ longer[:, words:] if len(longer) else np.zeros((0, words), np.uint64)
            mine = np.frombuffer(b"".join(sketches[i] for i in own), "<u8").reshape(len(own), words)
            longer = np.concatenate([half, mine])
            places = own if not self.folded else np.concatenate([self.folded[0][1], own])
            at = np.full(len(sketches), -1)
            at[places] = np.arange(len(places))
            self.folded.insert(0, (at, places, longer))

    def apart(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether the sketches at places x and y differ in more than `most` bits, at the least length first."""
        out = np.zeros(len(x), bool)
        top = np.minimum(self.level[x], self.level[y])
        for level, (at, _, matrix) in enumerate(self.folded):
            left = np.flatnonzero((top >= level) & ~out) if level == 0 else np.flatnonzero((top == level) & ~out)
            if len(left):
                differ = np.bitwise_count(matrix[at[x[left]]] ^ matrix[at[y[left]]]).sum(1, dtype=np.int64)
                out[left] = differ > most[left]
        return out


def most_apart(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Elements in which two sets at the similarity differ at most; sizes: their sizes' sum."""
    return (1 - similarity) / (1 + similarity) * sizes + 1e-6


def may_overlap(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets can be at the similarity if this is the first element that they share. a and b: size << 32 | place of the element in the set's order."""
    n, m = a >> 32, b >> 32
    return np.minimum(n - (a & 0xFFFFFFFF), m - (b & 0xFFFFFFFF)) >= similarity / (1 + similarity) * (n + m) - 1e-6


def close_places(starts: np.ndarray, n: int, test) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (a, b) that pass test(a, b) in the runs of at most SHORT_RUN rows among n rows; starts: the runs' first places."""
    size = np.diff(np.append(starts, n))
    size_of, run_of = np.repeat(size, size), np.repeat(np.arange(len(size)), size)
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for shift in range(1, min(SHORT_RUN, n)):
        at = np.flatnonzero((size_of[:-shift] <= SHORT_RUN) & (run_of[:-shift] == run_of[shift:]))
        if not len(at):
            break
        at = at[test(at, at + shift)]
        first.append(at)
        second.append(at + shift)
    return np.concatenate(first), np.concatenate(second)


def meet(similarity: float, most_run: int):
    """Over rows (key, salt, node, at) sorted by key, salt, node: (kind, key, node, at). Kind 1: rows that may be similar to another of their key, by sizes and places, and all rows of keys with over most_run rows. Kind 0: rows of salted keys, which all become candidates of each other."""

    def run(batches):
        held, passing = None, None
        for b in itertools.chain(batches, [None]):
            if b is None:
                rows, held = held, None
            else:
                rows = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
                rows = rows if held is None else np.concatenate([held, rows], 1)
            if rows is None or not rows.shape[1]:
                continue
            rows = rows[:, np.concatenate([[True], (rows[:3, 1:] != rows[:3, :-1]).any(0)])]  # a set that several tasks have met
            starts = np.concatenate([[0], np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(0)) + 1])
            ends = np.append(starts[1:], rows.shape[1])
            hot = (rows[1, starts] > 0) | (ends - starts > most_run)
            if passing == tuple(rows[:2, 0]):
                hot[0] = True
            passing = None
            if b is not None:  # the last run may go on
                if hot[-1]:
                    passing, held = tuple(rows[:2, -1]), rows[:, -1:]  # its last row stays, to find repeated ones
                else:
                    held, rows, starts, ends, hot = rows[:, starts[-1] :], rows[:, : starts[-1]], starts[:-1], ends[:-1], hot[:-1]
            star = rows[1] > 0
            useful = np.repeat(hot, ends - starts)
            at = rows[3]
            for places in close_places(starts, rows.shape[1], lambda x, y: may_overlap(at[x], at[y], similarity)):  # noqa: B023
                useful[places] = True
            for s, e in zip(starts[(ends - starts > SHORT_RUN) & ~hot], ends[(ends - starts > SHORT_RUN) & ~hot], strict=True):
                for x in range(s, e - 1):
                    near = may_overlap(at[x + 1 : e], at[x], similarity)
                    useful[x + 1 : e] |= near
                    useful[x] |= near.any()
            useful &= ~star
            for kind, some in ((0, star), (1, useful)):
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), kind, np.int32)), pa.array(rows[0, some]), pa.array(rows[2, some]), pa.array(rows[3, some])], ["kind", "key", "node", "at"])

    return run


def sketched(similarity: float):
    """Over rows (key, node, at, odd) sorted by key: links (src, dst) of nodes that neither places nor sketches rule out; of a key with many rows a spanning forest, for which a row meets only those of sizes that allow the similarity."""

    def run(batches):
        held = None
        for b in itertools.chain(batches, [None]):
            if b is None:
                now, held = held, None
            else:
                now = (np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]), b.column(3).to_pylist())
                now = now if held is None else (np.concatenate([held[0], now[0]], 1), held[1] + now[1])
            if now is None or not now[1]:
                continue
            rows, odd = now
            starts = np.concatenate([[0], np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1])
            if b is not None:
                cut = starts[-1]
                held = rows[:, cut:], odd[cut:]
                rows, odd, starts = rows[:, :cut], odd[:cut], starts[:-1]
            if not odd:
                continue

            def near(x, y, rows=rows, sketches=Sketches(odd)):
                ok = may_overlap(rows[2, x], rows[2, y], similarity)
                at = np.flatnonzero(ok)
                x, y = x[at], y[at]
                ok[at] = ~sketches.apart(x, y, most_apart((rows[2, x] >> 32) + (rows[2, y] >> 32), similarity))
                return ok

            first, second = close_places(starts, len(odd), near)
            links = [(first, second)]
            ends = np.append(starts[1:], len(odd))
            for s, e in zip(starts[ends - starts > SHORT_RUN], ends[ends - starts > SHORT_RUN], strict=True):
                size = rows[2] >> 32
                rest, queue = s + np.argsort(size[s:e], kind="stable"), []
                while len(rest):
                    if not queue:
                        queue, rest = [rest[0]], rest[1:]
                        continue
                    x = queue.pop()
                    i, j = np.searchsorted(size[rest], (similarity * size[x] - 1e-3, size[x] / similarity + 1e-3))
                    some = rest[i:j]
                    ok = near(some, np.full(len(some), x))
                    if ok.any():
                        links.append((np.full(int(ok.sum()), x), some[ok]))
                        queue.extend(some[ok])
                        rest = np.concatenate([rest[:i], some[~ok], rest[j:]])
            src, dst = (rows[1, np.concatenate(x)] for x in zip(*links, strict=True))
            if len(src):
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    return run


def alike(met: DataFrame, nodes: DataFrame, similarity: float, slice_bytes: int, write: Callable[[DataFrame], DataFrame], wrap: Callable = lambda run: run) -> DataFrame:
    """Links (src, dst) of the rows of kind 1 of meet; nodes: (node, odd); write: stores a table. Unrelated texts share more elements the more texts there are, and each such row takes a sketch: the keys go through in slices, by their rows' bytes, and a slice's files are gone before the next."""
    rows = met.where("kind = 1")
    sketch = F.greatest(F.lit(LEAST_SKETCH), F.least(F.lit(MOST_SKETCH), F.shiftright("at", 31))) / 8  # up to twice as many bits as elements
    partitions = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, -int(-(rows.agg(F.sum(sketch + 24)).first()[0] or 0) // (slice_bytes * partitions)))
    found = []
    for i in range(slices):
        runs = rows.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == i).select("key", "node", "at")
        runs = runs.join(nodes.select("node", "odd"), "node").select("key", "node", "at", "odd")
        found.append(write(runs.repartition("key").sortWithinPartitions("key").mapInArrow(wrap(sketched(similarity)), "src long, dst long").distinct()))
    return reduce(DataFrame.unionByName, found)
