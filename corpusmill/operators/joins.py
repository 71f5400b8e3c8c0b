"""Joins: collisions, derived keys, lookups, nesting, anti and semi, theta, similarity, range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stored import stored


def left_with_suffix(left: DataFrame, right: DataFrame, on: str, suffix: str = "_verified") -> DataFrame:
    """Left join; columns of the right side whose names collide get a suffix."""
    renamed = right.select(*[F.col(c).alias(c + suffix if c in left.columns and c != on else c) for c in right.columns])
    return left.join(renamed, on, "left")


def strip_prefix(c: Column, prefix: str = "neg_") -> Column:
    return F.regexp_replace(c, f"^{prefix}", "")


def left_on_derived(left: DataFrame, info: DataFrame, key: str, derived: Column) -> DataFrame:
    """Left join on a key computed from the left side; the helper is dropped."""
    return left.withColumn("_k", derived).join(info.withColumnRenamed(key, "_k"), "_k", "left").drop("_k")


def positive_with_negation(df: DataFrame, key: str, opposite: Column, flag: str, negative: str = "is_negation") -> DataFrame:
    """Each positive row with its negation's flag, false where there is none."""
    neg = df.where(negative).select(opposite.alias(key), F.col(flag).alias("neg_flag"))
    return df.where(f"not {negative}").join(neg, key, "left").select(key, F.col(flag).alias("pos_flag"), F.coalesce("neg_flag", F.lit(False)).alias("neg_flag"))


def positional(left: DataFrame, right: DataFrame, order_left: list[str], order_right: list[str], by: list[str]) -> DataFrame:
    """Join by position within a key of an explicit order, so that no global sort into one task is needed."""
    a = left.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(*order_left)))
    b = right.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(*order_right)))
    return a.join(b, [*by, "_i"]).drop("_i")


def lookup_last(left: DataFrame, right: DataFrame, on: str, order: str) -> DataFrame:
    """Inner join with the last row of each key of the right side."""
    others = [c for c in right.columns if c != on]
    last = right.groupBy(on).agg(F.max_by(F.struct(*others), F.col(order)).alias("r")).select(on, *[F.col("r")[c].alias(c) for c in others])
    return left.join(last, on)


def missing_keys(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of left that violate 'every key of left is in right'."""
    return left.join(right.select(on).distinct(), on, "left_anti")


def nest(left: DataFrame, right: DataFrame, on: str, fields: list[str], out: str) -> DataFrame:
    """Left outer join with an array of the right side's rows, in order; an empty array where there are none."""
    arrays = right.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(out))
    empty = F.array().cast(arrays.schema[out].dataType)
    return left.join(arrays, on, "left").withColumn(out, F.coalesce(F.col(out), empty))


def anti(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows whose key isn't in right; null keys stay."""
    return left.join(right.select(on).distinct(), on, "left_anti")


def semi(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right.select(on).distinct(), on, "left_semi")


def drop_contradicted(df: DataFrame, key: str, opposite: Column, solved: Column) -> DataFrame:
    """Rows whose opposite polarity isn't solved."""
    return df.join(df.where(solved).select(opposite.alias(key)).distinct(), key, "left_anti")


def within_record(df: DataFrame, records: DataFrame, key: str, opposite: Column, most: int) -> DataFrame:
    """Rows with at most `most` recorded proofs, whose opposite has none."""
    own = records.select(F.col(key), F.col("proof_count").alias("own"))
    other = records.select(F.col(key).alias("_o"), F.col("proof_count").alias("other"))
    joined = df.join(own, key, "left").withColumn("_o", opposite).join(other, "_o", "left").drop("_o")
    return joined.where((F.coalesce("own", F.lit(0)) <= most) & (F.coalesce("other", F.lit(0)) == 0)).drop("own", "other")


#: Bytes of passages that are sent to all tasks at once.
PASSAGE_BYTES = 8 << 20


def contains_join(texts: DataFrame, passages: DataFrame, text: str, passage: str, gram: int = 20, most_bytes: int = PASSAGE_BYTES) -> DataFrame:
    """Pairs where a text contains a passage. A passage is looked up by its first `gram` characters at the places
    where words start: their hashes meet with a hash of the whole text alone, and only the texts and passages of
    pairs that meet are fetched and verified. Passages shorter than that, or that don't start like a word, are compared with every
    text, in slices of measured size that are sent to all tasks. Null texts and passages match nothing."""
    p = passages.where(F.col(passage).isNotNull()).withColumn("_p", F.xxhash64(passage))
    short = (F.length(passage) < gram) | ~F.col(passage).rlike(r"^\w")
    t = texts.where(F.col(text).isNotNull()).withColumn("_t", F.xxhash64(text))
    starts = F.transform(F.regexp_extract_all(F.col(text), F.lit(rf"(?s)(?=(?<!\w)(\w.{{{gram - 1}}}))\w"), F.lit(1)), lambda x: F.xxhash64(x))
    grams = t.select("_t", F.explode(F.array_distinct(starts)).alias("_g"))
    asked = p.where(~short).select("_p", F.xxhash64(F.substring(passage, 1, gram)).alias("_g"))
    met = stored(grams.join(asked, "_g").select("_t", "_p").distinct())
    out = t.join(met, "_t").join(p, "_p").where(F.col(text).contains(F.col(passage))).drop("_t", "_p")
    size = p.where(short).agg(F.sum(F.length(passage) + 64)).first()[0] or 0
    slices = -(-size // most_bytes)
    for k in range(slices):
        some = p.where(short & (F.pmod(F.xxhash64("_p"), F.lit(slices)) == k)).drop("_p")
        out = out.unionByName(t.drop("_t").join(F.broadcast(some), F.col(text).contains(F.col(passage))))
    return out


def first_match(pairs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key's matches the first."""
    return pairs.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def range_join(points: DataFrame, ranges: DataFrame, by: list[str], at: str, start: str, end: str, bin_size: int | None = None) -> DataFrame:
    """Points inside [start, end] of the same key; with bin_size, ranges are cut into bins, which makes it an equi-join on key and bin."""
    inside = F.col(at).between(F.col(start), F.col(end))
    if not bin_size:
        return points.join(ranges, by).where(inside)
    p = points.withColumn("_b", F.floor(F.col(at) / bin_size))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size))))
    return p.join(r, [*by, "_b"]).where(inside).drop("_b")


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(v):
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    return dot / (norm(a) * norm(b))


def max_similarity(vectors: DataFrame, truth: DataFrame, vector: str = "embedding", most_bytes: int = 64 << 20) -> DataFrame:
    """Each vector's largest cosine against the ground-truth set. The set is a stated query set: it is collected only
    after its size is checked, and compared block by block against every Arrow batch; beyond the limit the set is
    taken in slices below it, one after another, and the largest value of all slices is kept."""
    import numpy as np
    import pyarrow as pa

    rows = truth.select(F.col(vector).alias("v")).where("v is not null")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    slices = max(1, -(-(n * (width or 0) * 8) // most_bytes)) if most_bytes else max(1, n)
    key = vectors.columns[0]
    if slices > 1:
        parts = [max_similarity(vectors, truth.where(F.pmod(F.xxhash64(vector), F.lit(slices)) == k), vector, 1 << 62) for k in range(slices)]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.groupBy(key).agg(F.max("max_cosine").alias("max_cosine"))
    g = np.array([r["v"] for r in rows.collect()], np.float64)
    if not len(g):
        return vectors.select(key, F.lit(None).cast("double").alias("max_cosine")).where("false")
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    sent = vectors.sparkSession.sparkContext.broadcast(g)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(1).to_pylist(), np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            best = np.max([(x @ sent.value[i : i + 1000].T).max(1) for i in range(0, len(sent.value), 1000)], axis=0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best)], [key, "max_cosine"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, vector).mapInArrow(run, f"{key} {kind}, max_cosine double")


def pairs_within(df: DataFrame, by: str, order: str, fields: list[str]) -> DataFrame:
    """All pairs of rows of a group, the earlier first."""
    a = df.select(by, *[F.col(f).alias(f"{f}_a") for f in fields])
    b = df.select(by, *[F.col(f).alias(f"{f}_b") for f in fields])
    return a.join(b, by).where(F.col(f"{order}_a") < F.col(f"{order}_b"))
