"""Best-fit packing with certified bin counts.

Documents become pieces of at most CAPACITY tokens. Pieces are dealt to partitions of bounded size; each
partition packs best-fit decreasing and compares its bin count with the lower bound of a family of dual
feasible functions (the rounding family u(k) and the threshold family of Fekete and Schepers). A partition
whose count meets its bound is certified. The partitions with a gap give up their bins with room, exchange
those pieces by a new deal and run best-fit decreasing again, for a few rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_path, encoder, pieces_of
from .common import lean, persisted

CAPACITY = 1024
#: End-of-document token.
END_ID = 2
#: Pieces that one partition packs.
PARTITION_PIECES = 60_000
ROUNDS = 3


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """A proven least number of bins for pieces of these sizes: the best of the plain volume bound and two families of dual feasible functions."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    for t in range(1, capacity // 2 + 1):  # f_t: above capacity - t whole, below t nothing
        f = np.where(x > capacity - t, capacity, np.where(x < t, 0, x))
        best = max(best, -(-int((count * f).sum()) // capacity))
    for k in range(1, 21):  # u_k: multiples of 1/(k+1) stay, else floor((k+1)x)/k
        whole = (k + 1) * x
        f = np.where(whole % capacity == 0, x * k, whole // capacity * capacity)
        best = max(best, -(-int((count * f).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Bins with equal room are kept together, and the set of rooms in use is a bit mask, so a piece takes constant time."""
    n = len(sizes)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, opened = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fitting = mask >> s
        if fitting:
            room = s + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, b, opened = capacity, opened, opened + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - s:
            rooms[left].append(b)
            mask |= 1 << left
    return bins, offsets


ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{ITEM}, part long, bin long, offset long, done boolean"


def document_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int | None = END_ID) -> DataFrame:
    """Pieces of every row of docs: doc_id, piece, start, length, ids_crc32. Null text: as empty, one piece that holds the end token."""
    path = path or default_path()
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            rows = [(d, k, *p) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, p in enumerate(pieces_of(enc.ids(t or "") + tail, capacity))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), ITEM)


def _pack(capacity: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable", na_position="first").reset_index(drop=True)
        sizes = pdf["length"].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(sizes, capacity)
        n = int(bins.max()) + 1
        certified = n == lower_bound(sizes, capacity)
        filled = np.bincount(bins, sizes, n)
        pdf["part"] = np.int64(key[0])
        pdf["bin"], pdf["offset"] = bins, offsets
        pdf["done"] = certified | (filled[bins] == capacity)
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "part", "bin", "offset", "done"]]

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Add sequence_id and offset to pieces (ITEM columns). Every piece comes back once.

    Whole pieces of `capacity` tokens are sequences of their own and are not dealt. The others go to partitions of
    about `partition_pieces` by a hash; partitions without a gap to their lower bound are certified and final, as
    are full bins; the rest is dealt anew, to fewer partitions each round, and what the last round has is kept.
    Only the count of the open pieces comes to the driver. Repeated rows and null ids pass through as pieces of
    their own; an empty table gives an empty result.
    """
    pieces = persisted(pieces)
    whole = pieces.where(F.col("length") == capacity)
    open_, left = pieces.where(F.col("length") < capacity), None
    out: list[DataFrame] = []
    for r in range(rounds):
        left = open_.count()
        if not left:
            break
        n = max(1, round(left / partition_pieces))
        dealt = open_.withColumn("part", F.pmod(F.xxhash64(F.lit(r), F.monotonically_increasing_id()), F.lit(n)))  # by place in a written table: even, and the same when a task is repeated
        packed = persisted(dealt.groupBy("part").applyInPandas(_pack(capacity), PACKED))
        packed = packed.withColumn("part", F.col("part") + F.lit((r + 1) << 32))
        last = r == rounds - 1 or n == 1
        out.append(packed if last else packed.where("done"))
        if last:
            break
        open_ = packed.where("not done").select("doc_id", "piece", "start", "length", "ids_crc32")
    # negative numbers for whole pieces, so that they never meet a packed bin's number
    sequences = whole.withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", F.lit(0).cast("long"))
    for packed in out:
        sequences = sequences.unionByName(packed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("part") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), "offset"))
    return sequences


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for all rows of docs; see document_pieces and pack_pieces."""
    return pack_pieces(document_pieces(docs, path))


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences used, tokens, and the volume lower bound."""
    return packed.agg(F.countDistinct("sequence_id").alias("n_sequences"), F.sum("length").alias("n_tokens"), F.ceil(F.sum("length") / F.lit(capacity)).alias("lower_bound"))
