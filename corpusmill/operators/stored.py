"""Tables written to the folder that all executors share, so that what reads them never repeats what made them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


#: Whether Spark deletes a query's shuffle files when the query ends, not only when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset and executors are threads of this machine (tests)."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _own_dir()
    return path.rstrip("/")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    import tempfile

    return tempfile.mkdtemp(prefix="corpusmill-")


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go with the write: nothing reads them later."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. A lost executor repeats nothing that lies before it."""
    path = scratch(df.sparkSession)
    with _cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str) -> DataFrame:
    """The same, dealt to buckets by key: joins by it alone shuffle the other side only. The catalog forgets the table at once; its files stay."""
    spark, table = df.sparkSession, f"corpusmill_{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.repartition(key).write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", scratch(spark)).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out
