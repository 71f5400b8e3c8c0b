"""Sources: parquet, csv, json, text, logs; one function each, all lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, split: str | None = None, revision: str | None = None) -> DataFrame:
    """A parquet table or directory of shards; a revision is a subfolder, a split a partition value."""
    df = spark.read.parquet(f"{path}/{revision}" if revision else path)
    return df.where(F.col("split") == split) if split else df


def read_shard(spark: SparkSession, path: str, shard_id: str) -> DataFrame:
    """One shard of a table partitioned by shard_id; only its folder is read."""
    return spark.read.parquet(path).where(F.col("shard_id") == shard_id)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """JSON lines, or one document a file; undecodable rows give nulls."""
    r = spark.read.option("mode", "PERMISSIVE").option("multiLine", multi_line)
    return (r.schema(schema) if schema else r).json(path)


def read_json_files(spark: SparkSession, glob: str) -> DataFrame:
    """Whole JSON files as (folder, stem, doc VARIANT); files that can't be decoded are left out."""
    raw = spark.read.option("wholetext", True).text(glob)
    path = F.col("_metadata.file_path")
    named = raw.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), F.try_parse_json("value").alias("doc"))
    return named.where("doc is not null")


def read_folders(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """A directory of directories as one row for each folder with one of the named files, a column of text for each of them."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    file = F.col("_metadata.file_path")
    named = raw.select(F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract(file, r"([^/]+)$", 1).alias("name"), "value")
    return named.where(F.col("name").isin(*names)).groupBy("folder").pivot("name", list(names)).agg(F.first("value"))


def list_files(spark: SparkSession, path: str, pattern: str = "*.lean") -> DataFrame:
    """Paths and sizes of the files below path whose name fits the pattern. Spark leaves empty files out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return raw.select("path", "length")


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def log_times(lines: DataFrame, column: str = "value") -> DataFrame:
    """The first time of a log: lines are 'time | level | message'; those that don't parse are skipped."""
    t = F.try_to_timestamp(F.trim(F.split(column, r" \| ")[0]), F.lit("yyyy-MM-dd HH:mm:ss"))
    return lines.select(t.alias("t")).agg(F.min("t").alias("first_time"), F.max("t").alias("last_time"), F.count("t").alias("parsed_lines"))
