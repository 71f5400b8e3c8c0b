"""Union, copies, dedup, near-dedup, sampling, sharding and mixing; everything by hash, so that reruns agree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .overlap import MOST_SAME, SLICE_BYTES, alike, digest_of, meet, node_of, odd_sketch
from .stored import stored, stored_by

#: Sets of one task that are compared pair by pair.
CELL = 4000


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    for o in others:
        first = first.unionByName(o, allowMissingColumns=True)
    return first


def copies(df: DataFrame, k: int, out: str = "copy") -> DataFrame:
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(k - 1)))) if k > 0 else df.withColumn(out, F.lit(0)).limit(0)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first by order; an aggregation, so hot keys combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest]).select(*df.columns)


def unit_hash(key: Column, seed: str = "") -> Column:
    """A number in [0, 1) that depends on the key's text alone (52 bits of SHA-256)."""
    return F.conv(F.substring(F.sha2(F.concat(key.cast("string"), F.lit(seed)), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def weighted_keep(df: DataFrame, key: str, negation: Column, rate: Column, beta: float = 1.0) -> DataFrame:
    """Keep with probability (1 - 0.8 neg)(1 - 0.95 rate)^beta; the rate is held to [0, 1]."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate))
    p = (1 - 0.8 * negation.cast("double")) * F.pow(1 - 0.95 * r, F.lit(beta))
    return df.where(p > unit_hash(F.col(key)))


def hash_split(df: DataFrame, key: str, share: float, override: Mapping[str, str], source: str) -> DataFrame:
    """split: a source's own split if it has one, else validation for a share of keys, else train."""
    split = F.when(unit_hash(F.col(key)) < share, "validation").otherwise("train")
    for name, to in override.items():
        split = F.when(F.col(source) == name, to).otherwise(split)
    return df.withColumn("split", split)


def hash_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows without replacement: the least by a salted hash (a top-k, no full sort)."""
    return df.orderBy(F.sha2(F.concat(F.col(key).cast("string"), F.lit(seed)), 256), key).limit(n)


def sample_with_replacement(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    return df.sample(withReplacement=True, fraction=fraction, seed=seed)


def global_rank(df: DataFrame, order: list[Column], out: str, partitions: int | None = None) -> DataFrame:
    """Row numbers from 0 over a total order without sorting everything in one task: range partitions, a count of each, and row numbers inside them. The counts, one a partition, are the only thing that is gathered."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))).select("_p", F.coalesce("_before", F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    return numbered.join(F.broadcast(before), "_p").withColumn(out, F.col("_r") - 1 + F.col("_before")).drop("_p", "_r", "_before")


def take_fraction(df: DataFrame, key: str, fraction: float, seed: str) -> DataFrame:
    """Exactly floor(n * fraction) rows, the first in hash order; ranked over range partitions, so that a large share isn't a limit in one task."""
    n = df.count()
    hashed = df.withColumn("_h", F.sha2(F.concat(F.col(key).cast("string"), F.lit(seed)), 256))
    return global_rank(hashed, [F.col("_h"), F.col(key)], "_rank").where(F.col("_rank") < int(n * fraction)).drop("_h", "_rank")


def mixture(parts: Mapping[str, tuple[DataFrame, int | float]], key: str, seed: str = "142") -> DataFrame:
    """A whole coefficient repeats a part, a fraction takes that share of it."""
    out = [(copies(df, c) if isinstance(c, int) else take_fraction(df, key, c, seed).withColumn("copy", F.lit(0))).withColumn("part", F.lit(name)) for name, (df, c) in parts.items()]
    return union_all(*out)


def row_shards(df: DataFrame, order: list[Column], size: int, width: int = 5) -> DataFrame:
    """Fixed-size shards over a total order, with zero-padded ids."""
    return global_rank(df, order, "_i").withColumn("shard_id", F.lpad(F.floor(F.col("_i") / size).cast("string"), width, "0")).drop("_i")


def key_shards(df: DataFrame, key: str, keys_a_shard: int) -> DataFrame:
    """All rows of a key in one shard, a fixed number of keys a shard."""
    ranked = global_rank(df.select(key).distinct(), [F.col(key)], "_i").select(key, F.floor(F.col("_i") / keys_a_shard).alias("shard"))
    return df.join(ranked, key)


def route(key: Column, targets: list[str]) -> Column:
    """One of the targets by the key's hash."""
    return F.element_at(F.array(*map(F.lit, targets)), (F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % len(targets) + 1).cast("int"))


def shingles(text: Column, n: int) -> Column:
    """Distinct word n-grams; fewer words give the whole text's words as one."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


SIGNED = "s array<bigint>, h array<bigint>, digest binary"


def _signatures(n: int, bands: int, rows: int):
    """Batches (key, text) to (key, the shingle set, a hash for each band, the set's digest); rows without words are left out."""
    import hashlib

    import numpy as np
    import pyarrow as pa
    import xxhash

    rng = np.random.default_rng(1)
    odd, add = (rng.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    fold = rng.integers(0, 1 << 63, (1, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for b in batches:
            keys, shingle_sets, bandings, digests = [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (text or "").lower().split()
                if not words:
                    continue
                grams = {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}
                h = np.sort(np.array([xxhash.xxh64_intdigest(g) for g in grams], np.uint64))
                least = np.full(bands * rows, np.iinfo(np.uint64).max)
                for i in range(0, len(h), 2048):  # blocks, however long the text
                    x = h[None, i : i + 2048] * odd + add
                    least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(1))
                keys.append(key)
                shingle_sets.append(h.view(np.int64))
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                bandings.append((least.reshape(bands, rows) * fold).sum(1, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(shingle_sets, pa.list_(pa.int64())), pa.array(bandings, pa.list_(pa.int64())), pa.array(digests, pa.binary())], ["key", "s", "h", "digest"])

    return run


def minhash_pairs(df: DataFrame, key: str, text: str, n: int = 5, permutations: int = 250, threshold: float = 0.7, spanning: bool = False, cell: int = CELL) -> DataFrame:
    """Near-duplicate links (src, dst, jaccard) by MinHash bands, verified by exact Jaccard of the shingle sets.

    Equal sets meet by their digest and are linked to their least key. Representatives that share a band become
    candidates by a link to the bucket's least key, so candidate links grow with the rows; the candidates that are
    so connected meet in a group, the sets sent there once, and every pair of a group is compared. A group of more
    than `cell` sets is dealt to cells of two blocks, which hold every pair once. With spanning only such links of
    a cell come back as its groups of similar sets need, not every pair. Null and wordless texts have no links.
    """
    bands, rows = _bands(permutations, threshold)
    kind = df.schema[key].dataType.simpleString()
    sets = stored(df.select(key, text).mapInArrow(_signatures(n, bands, rows), f"key {kind}, {SIGNED}"))
    equal = stored(sets.groupBy("digest").agg(F.min("key").alias("rep"), F.first("h").alias("h"), F.count("*").alias("n")))
    keyed = equal.select("rep", F.posexplode("h").alias("band", "h"))
    heads = keyed.groupBy("band", "h").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1")
    met = components(keyed.join(heads, ["band", "h"]).where("rep != head").select(F.col("rep").alias("src"), F.col("head").alias("dst")).distinct())
    first = sets.groupBy("digest").agg(F.first("s").alias("s")).join(equal.select("digest", "rep"), "digest")
    members = first.join(met.withColumnRenamed("node", "rep"), "rep").select("root", "rep", "s")
    blocks = members.groupBy("root").agg(F.ceil(F.count("*") / F.lit(cell / 2)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = members.join(blocks, "root").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "s")
    found = cells.groupBy("root", "i", "j").applyInPandas(_compare(threshold, spanning), f"src {kind}, dst {kind}, jaccard double").distinct()
    copies_ = sets.join(equal.where("n > 1").select("digest", "rep"), "digest").where("key != rep").select(F.col("key").alias("src"), F.col("rep").alias("dst"), F.lit(1.0).alias("jaccard"))
    return found.unionByName(copies_)


def _compare(threshold: float, spanning: bool, columns: tuple[str, str, str] = ("src", "dst", "jaccard")):
    """All pairs of a cell's sets at the threshold, or enough of them to connect the similar sets; in each the greater key first."""
    import numpy as np
    import pandas as pd

    def run(key, pdf):
        pdf = pdf.sort_values("rep", kind="stable").reset_index(drop=True)
        i, j = int(key[1]), int(key[2])
        reps, own = pdf["rep"].to_numpy(), pdf["own"].to_numpy()
        size = pdf["s"].map(len).to_numpy(np.int64)
        _, codes = np.unique(np.concatenate(pdf["s"].tolist()), return_inverse=True)
        starts = np.cumsum(size) - size
        mark, root, out = np.zeros(int(codes.max()) + 1, bool), np.arange(len(pdf)), []
        for x in range(len(pdf) - 1):
            mark[codes[starts[x] : starts[x] + size[x]]] = True
            inner = np.add.reduceat(mark[codes[starts[x + 1] :]], starts[x + 1 :] - starts[x + 1], dtype=np.int64)
            mark[codes[starts[x] : starts[x] + size[x]]] = False
            jaccard = inner / (size[x] + size[x + 1 :] - inner)
            near = (jaccard >= threshold) & ((own[x + 1 :] != own[x]) | (i == j))
            if spanning:
                near &= root[x + 1 :] != root[x]
            for y in (np.flatnonzero(near) + x + 1).tolist():
                if spanning and root[y] == root[x]:
                    continue
                out.append((reps[y], reps[x], float(jaccard[y - x - 1])))
                root[root == root[y]] = root[x]
        return pd.DataFrame(out, columns=columns)

    return run


def _bands(permutations: int, threshold: float) -> tuple[int, int]:
    """The split into bands and rows whose step is nearest below the threshold."""
    best = min(((permutations // r, r) for r in range(1, permutations + 1)), key=lambda br: abs((1 / br[0]) ** (1 / br[1]) - (threshold - 0.15)))
    return best


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 50) -> DataFrame:
    """(node, root) by minimum labels with pointer jumping; each round's labels are written so that lineage stays short."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    e = stored(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = e.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root")
    for _ in range(rounds):
        around = e.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        new = labels.join(around, F.col("node") == F.col("a")).select("node", F.least("root", "m").alias("root"), F.col("root").alias("old"))
        jump = new.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = stored(new.join(jump, "root", "left").select("node", F.coalesce(F.least("far", "root"), "root").alias("root"), "old"))
        moved = new.where("root != old").limit(1).count()
        labels = new.select("node", "root")
        if not moved:
            return labels
    raise RuntimeError("components did not settle")


def near_dedup(df: DataFrame, key: str, text: str, n: int = 5, permutations: int = 250, threshold: float = 0.7) -> DataFrame:
    """One row of each near-duplicate cluster, that with the least key."""
    roots = components(minhash_pairs(df, key, text, n, permutations, threshold, spanning=True).select("src", "dst"))
    gone = roots.where("node != root").select(F.col("node").alias(key))
    return df.join(gone, key, "left_anti")


#: Sets whose shingles are counted for the order of prefixes, and shingles that so get a place behind the others.
COUNTED, COMMON = 4000, 200_000
#: Links whose ends are sent to all tasks that read texts; the ends of more are joined by a shuffle of the texts.
FEW = 65_000


def _grams(text: str | None, n: int):
    """The sorted hashes of a text's distinct word n-grams, as _signatures takes them; none without words."""
    import numpy as np
    import xxhash

    words = (text or "").lower().split()
    return np.sort(np.array([xxhash.xxh64_intdigest(g) for g in {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}] if words else [], np.uint64))


def _described(n: int, share: float):
    """Batches (key, text) to (key, digest, node, odd, sample): the set's digest, name and sketch, and of a share of the rows the set. Rows without words are left out."""
    import zlib

    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if len(h := _grams(text, n)):
                    digest = digest_of(h)
                    at.append(i)
                    rows.append((digest, node_of(digest), odd_sketch(h), h.view(np.int64) if zlib.crc32(digest) < share * 2**32 else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["key", "digest", "node", "odd", "sample"])

    return run


def _common(signed: DataFrame) -> tuple[list[int], list[int]]:
    """Shingles that several of a bounded number of sets have, and how many. They set the order of the prefixes, never what is compared in the end."""
    sample = signed.where("sample is not null").limit(2 * COUNTED).groupBy("digest").agg(F.first("sample").alias("s"))
    rows = sample.select(F.explode("s").alias("t")).groupBy("t").count().where("count > 1").orderBy(F.desc("count"), "t").limit(COMMON).collect()
    return [r["t"] for r in rows], [r["count"] for r in rows]


def _prefixes(threshold: float, n: int, common: tuple[list[int], list[int]]):
    """Batches (text) to the rows (key, salt, node, at) of the prefix of every set that the task hasn't met, rare shingles first; at: size << 32 | place."""
    import math

    import numpy as np
    import pyarrow as pa

    shingle, count = np.array(common[0], np.int64).view(np.uint64), np.array(common[1], np.int64)
    shingle, count = shingle[order := np.argsort(shingle)], count[order]

    def run(batches):
        seen = set()
        for b in batches:
            for i in range(0, b.num_rows, 500):
                held = []
                for text in b.column(0).slice(i, 500).to_pylist():
                    t = _grams(text, n)
                    if not len(t) or (digest := digest_of(t)) in seen:
                        continue
                    seen.add(digest)
                    k, size = len(t) - math.ceil(threshold * len(t) - 1e-9) + 1, len(t)
                    if len(shingle):
                        at = np.minimum(np.searchsorted(shingle, t), len(shingle) - 1)
                        t = t[np.argsort(np.where(shingle[at] == t, count[at], 0), kind="stable")]
                    held.append((t[:k].view(np.int64), np.full(k, node_of(digest), np.int64), size << 32 | np.arange(k)))
                if held:
                    key, node, at = (np.concatenate(x) for x in zip(*held, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(len(key), np.int32)), pa.array(node), pa.array(at)], ["key", "salt", "node", "at"])

    return run


def _sets_of(n: int):
    """Batches (root, blocks, rep, digest, text) to (root, blocks, rep, s); texts of another digest, under a repeated key, are left out."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                some = b.slice(i, 500)
                found = [(k, h.view(np.int64)) for k, (d, t) in enumerate(zip(some.column(3).to_pylist(), some.column(4).to_pylist(), strict=True)) if digest_of(h := _grams(t, n)) == d]
                some = some.take(pa.array([k for k, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array([h for _, h in found], pa.list_(pa.int64()))], ["root", "blocks", "rep", "s"])

    return run


def jaccard_pairs(df: DataFrame, key: str, text: str, n: int = 5, threshold: float = 0.7, most_run: int = MOST_SAME, slice_bytes: int = SLICE_BYTES, cell: int = CELL) -> DataFrame:
    """All pairs (src < dst) of distinct shingle sets, each by its least key, whose Jaccard similarity is at least the
    threshold. Exact: in a common order of the shingles, two such sets share one of the first
    size - ceil(threshold * size) + 1 of either, so only these prefixes meet, rare shingles first. Sets that sizes,
    places and sketches don't rule out are linked to candidate groups; their sets alone are sent, once for a group (or a
    cell of it, beyond `cell` sets), and every pair is verified there. Rows with sketches are taken in slices of keys."""
    kind = df.schema[key].dataType.simpleString()
    share = min(1.0, COUNTED / max(1, df.count()))
    signed = stored(df.select(key, text).mapInArrow(_described(n, share), f"key {kind}, digest binary, node long, odd binary, sample array<long>"))
    nodes = stored_by(signed.groupBy("digest").agg(F.min("key").alias("rep"), *[F.first(c).alias(c) for c in ("node", "odd")]), "node")
    prefix = df.select(text).mapInArrow(_prefixes(threshold, n, _common(signed)), "key long, salt int, node long, at long")
    met = stored(prefix.repartition("key").sortWithinPartitions("key", "salt", "node").mapInArrow(meet(threshold, most_run), "kind int, key long, node long, at long"))
    found = alike(met, nodes, threshold, slice_bytes, stored).where("src != dst")
    roots = components(found)
    links = stored(found.distinct())
    members = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(roots, "node").join(nodes, "node").select("root", "rep", "digest")
    members = members.join(members.groupBy("root").agg(F.ceil(F.count("*") / F.lit(cell / 2)).cast("int").alias("blocks")), "root")
    few = F.broadcast(members) if links.limit(FEW + 1).count() <= FEW else members
    texts = df.select(F.col(key).alias("rep"), F.col(text).alias("text")).join(few, "rep").select("root", "blocks", "rep", "digest", "text")
    sets = texts.mapInArrow(_sets_of(n), f"root long, blocks int, rep {kind}, s array<bigint>")
    dealt = sets.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "s")
    pairs = cells.groupBy("root", "i", "j").applyInPandas(_compare(threshold, False, ("dst", "src", "jaccard")), f"dst {kind}, src {kind}, jaccard double")
    return pairs.where("src < dst").select("src", "dst", "jaccard").distinct()  # repeated rows of a least key
