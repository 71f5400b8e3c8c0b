"""Shared plumbing of the training-data operators: lineage cuts and connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides below this many bytes may be broadcast, after their size has been measured.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of our own where that is unset and executors are threads of this machine (tests)."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _own_dir()
    return path.rstrip("/")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="corpusmill-")


#: Whether Spark deletes a query's shuffle files when the query ends, not only when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go with the write: nothing reads them later."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def persisted(df: DataFrame, partitions: int | None = None, **options: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusmill/{uuid.uuid4().hex}"
    if partitions:
        df = df.repartition(partitions)
    with _cleaned(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """The same, dealt to buckets by key, as many as there are shuffle partitions: joins by that key read the buckets as they are, so that only the other side is shuffled. The catalog forgets the table at once; its files stay."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    path, table = f"{shared_dir(spark)}/corpusmill/{name}", f"corpusmill_{name}"
    with _cleaned(spark):
        df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that persisted has written. Only for those that nothing unwritten is read from any more."""
    for df in tables:
        if path := getattr(df, "_written", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def release_memory() -> None:
    """Give freed memory back to the system; Arrow's pool and the C library's heap keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about most_bytes, so that the objects made of one stay few where rows are long."""
    for b in batches:
        rows = max(1, b.num_rows * most_bytes // max(1, b.nbytes))
        for i in range(0, max(1, b.num_rows), rows):
            yield b.slice(i, rows)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run over slices of its batches, after which its worker, which Spark reuses for later stages, holds no memory that it has freed."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(sliced(batches))
        finally:
            release_memory()

    return wrapped


def lean_group(run: Callable):
    """The same for a function of a key and a group's rows."""

    def wrapped(key, pdf):
        try:
            return run(key, pdf)
        finally:
            release_memory()

    return wrapped


def small_enough(df: DataFrame, bytes_a_row: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df, counted now, is below the broadcast limit."""
    most = limit // bytes_a_row
    return df.limit(most + 1).count() <= most


def join_sized(left: DataFrame, right: DataFrame, on, how: str, bytes_a_row: int) -> DataFrame:
    """Join that broadcasts the right side only where its measured size is below the limit; else AQE's sort-merge join, which splits skewed keys."""
    return left.join(F.broadcast(right) if small_enough(right, bytes_a_row) else right, on, how)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that links reach.

    Alternating large-star and small-star rounds (O(log n) in practice). Every round is DataFrame joins and
    aggregations with map-side combining, and ends in a table in the shared folder, so that a lost executor
    repeats at most one round. Nodes must be orderable; null nodes and self-links are ignored.
    """
    a, b = F.col(src), F.col(dst)
    e = persisted(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())

    def settled(t: DataFrame) -> bool:
        """Whether every node hangs on one other, which hangs on none."""
        several = t.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        return several.isEmpty() and t.join(t.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()

    for _ in range(most_rounds):
        if settled(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = persisted(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        old = e
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = persisted(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(old, large)
    else:
        raise RuntimeError("connected components did not settle")
    children = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return children.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
