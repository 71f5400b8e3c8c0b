"""Projection, filters, windows, limits and arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILTERS: dict[str, Callable[..., Column]] = {}


def text_filter(f):
    """Register a filter by its name."""
    FILTERS[f.__name__] = f
    return f


@text_filter
def char_length(c: Column, low: int = 3, high: int = 3000) -> Column:
    return F.length(c).between(low, high)


@text_filter
def line_count(c: Column, low: int = 2, high: int = 150) -> Column:
    return F.size(F.split(c, "\n", -1)).between(low, high)


@text_filter
def token_count(c: Column, low: int = 3, high: int = 1500, pattern: str = r"\S+") -> Column:
    """Tokens by a pattern; pass a tokenizer's own count column to char_length-like filters for exact limits."""
    return F.regexp_count(c, F.lit(pattern)).between(low, high)


@text_filter
def occurrences(c: Column, word: str = "sorry", low: int = 1, high: int = 1) -> Column:
    return F.regexp_count(c, F.lit(word)).between(low, high)


@text_filter
def without_word(c: Column, word: str = "error") -> Column:
    return ~F.coalesce(c.contains(word), F.lit(False))


def filter_chain(df: DataFrame, column: str, chain: list[tuple[str, dict]]) -> DataFrame:
    """Named filters with their arguments, in order; Catalyst merges them into one predicate."""
    for name, kwargs in chain:
        df = df.where(FILTERS[name](F.col(column), **kwargs))
    return df


def valid_problem(kind: Column, answer: Column, problem_state: Column, solution_state: Column) -> Column:
    """Proof problems stay; others go if the answer wasn't found, the problem is incomplete or the solution invalid."""
    bad = (answer == "notfound") | (problem_state == "Incomplete") | (solution_state == "Invalid")
    return F.coalesce(kind == "proof", F.lit(False)) | ~F.coalesce(bad, F.lit(False))


def long_samples(df: DataFrame, keys: list[str], prefix: str, out: str, index: str = "sample_id") -> DataFrame:
    """Columns prefix1, prefix2, ... to rows; other columns with the prefix but no number stay out."""
    cols = [c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    return df.unpivot(keys, cols, "_name", out).withColumn(index, F.substring("_name", len(prefix) + 1, 10).cast("int")).drop("_name")


def wide_samples(df: DataFrame, keys: list[str], index: str, n: int, value: Column, prefix: str) -> DataFrame:
    """Rows to columns prefix1 .. prefixn."""
    wide = df.groupBy(*keys).pivot(index, list(range(1, n + 1))).agg(value)
    return wide.select(*keys, *[F.col(str(i)).alias(f"{prefix}{i}") for i in range(1, n + 1)])


def scatter_back(df: DataFrame, results: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Results of a filtered part, back on all rows."""
    joined = df.join(results, key, "left")
    return joined.select(*df.columns, *[F.coalesce(c, F.lit(d)).alias(c) if d is not None else F.col(c) for c, d in defaults.items()])


def running_or(df: DataFrame, key: str, order: list[str], flag: str, out: str) -> DataFrame:
    return df.withColumn(out, F.max(flag).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def disjoint_intervals(df: DataFrame, key: str, order: list[str], start: str, end: str) -> DataFrame:
    """Sorted intervals cut at the next one's start; empty ones are dropped afterwards."""
    nxt = F.lead(start).over(W.partitionBy(key).orderBy(*order))
    return df.withColumn(end, F.least(F.col(end), F.coalesce(nxt, F.col(end)))).where(F.col(start) < F.col(end))


def shift_trailing_space(df: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """Trailing white space of a row goes to the front of the next (for rows that aren't all white space)."""
    w = W.partitionBy(key).orderBy(*order)
    tail = F.regexp_extract(F.col(text), r"[ \t\n\r]*$", 0)
    return df.withColumn("_t", tail).withColumn(text, F.concat(F.coalesce(F.lag("_t").over(w), F.lit("")), F.regexp_replace(F.col(text), r"[ \t\n\r]+$", ""))).drop("_t")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def prefixes(df: DataFrame, parts: str, out: str = "prefix", at: str = "step") -> DataFrame:
    """Per step: what comes before it and what follows from it on."""
    return df.select("*", F.posexplode(parts).alias(at, "_x")).drop("_x").withColumn(out, F.array_join(F.slice(parts, F.lit(1), F.col(at)), "")).withColumn("suffix", F.array_join(F.slice(parts, F.col(at) + 1, F.size(parts)), ""))


def line_offsets(text: Column) -> Column:
    """Offset of each line's first character: array of bigint."""
    ls = F.split(text, "\n", -1)
    return F.slice(F.aggregate(ls, F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x) + 1))), F.lit(1), F.size(ls))


def first_n(df: DataFrame, order: list, n: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(n) if offset else df.orderBy(*order).limit(n)


def first_n_each(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def shortest(texts: Column, clean: Callable[[Column], Column]) -> Column:
    """Of cleaned texts the shortest, the first of equals."""
    return F.array_min(F.transform(texts, lambda x, i: F.struct(F.length(clean(x)).alias("n"), i.alias("i"), clean(x).alias("t"))))["t"]


def best_attempt(df: DataFrame, key: str, valid: str, feedback: str, order: str) -> DataFrame:
    """A valid attempt first, else the one with the shortest feedback, by order among equals."""
    rank = F.struct((~F.col(valid)).alias("bad"), F.when(F.col(valid), 0).otherwise(F.length(feedback)).alias("n"), F.col(order))
    return df.groupBy(key).agg(F.min_by(F.struct(order, valid), rank).alias("r")).select(key, "r.*")


def top_by_hash(df: DataFrame, key: str, seed: str) -> DataFrame:
    """One row, the least by a salted hash."""
    return df.orderBy(F.sha2(F.concat(F.col(key).cast("string"), F.lit(seed)), 256)).limit(1)
