"""Sinks: shards, splits, versions, resumable and append-only writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def write_shards(df: DataFrame, path: str, shard: str = "shard_id", rows_a_file: int | None = None) -> None:
    w = df.write.mode("overwrite").partitionBy(shard)
    (w.option("maxRecordsPerFile", rows_a_file) if rows_a_file else w).parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def publish(df: DataFrame, root: str, dataset: str, revision: str) -> str:
    """Write a version once; an existing one is an error."""
    path = f"{root}/{dataset}/{revision}"
    df.write.mode("error").parquet(path)
    return path


def pending(df: DataFrame, done_path: str, key: str) -> DataFrame:
    """Rows whose key the output doesn't have yet; all, if there is no output."""
    try:
        done = df.sparkSession.read.parquet(done_path)
    except AnalysisException:
        return df
    return df.join(done.select(key).distinct(), key, "left_anti")


def append_unseen(df: DataFrame, path: str, key: str = "id") -> None:
    """Append rows whose key is new, one of each (the least by all columns)."""
    first = df.groupBy(key).agg(F.min(F.struct(*[c for c in df.columns if c != key])).alias("r")).select(key, "r.*")
    pending(first, path, key).write.mode("append").parquet(path)
