"""Live progress over stage folders by Structured Streaming; run to the end of what is there, they equal the batch result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stage_stream(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 100) -> DataFrame:
    """New files of a folder (or one file) as a stream."""
    folder, _, name = path.rpartition("/")
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    return r.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else r.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def run_counts(counts: DataFrame, keys: list[str], value: str, where: str, once: bool = True):
    """Write running counts: every batch's changed keys replace the earlier ones by their batch number. Restarts go on from the checkpoint."""

    def put(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{where}/out/batch={batch}")

    w = counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{where}/checkpoint")
    return (w.trigger(availableNow=True) if once else w).start()


def latest(spark: SparkSession, where: str, keys: list[str], value: str) -> DataFrame:
    """The newest count of each key."""
    return spark.read.parquet(f"{where}/out").groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def progress_of(spark: SparkSession, path: str, schema: StructType, stage: str, where: str) -> DataFrame:
    """Finished rows of each stage."""
    counts = stage_stream(spark, path, schema).groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("finished"))
    run_counts(counts, ["stage"], "finished", where).awaitTermination()
    return latest(spark, where, ["stage"], "finished")


def counters_of(spark: SparkSession, path: str, schema: StructType, key: str, valid: Column, where: str) -> DataFrame:
    """Counter store: valid proofs of each statement."""
    counts = stage_stream(spark, path, schema).where(valid).groupBy(F.col(key).alias("statement_id")).agg(F.count("*").alias("proof_count"))
    run_counts(counts, ["statement_id"], "proof_count", where).awaitTermination()
    return latest(spark, where, ["statement_id"], "proof_count")
