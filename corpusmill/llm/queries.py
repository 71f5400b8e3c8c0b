"""Queries op1 to op10 and pipeline, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, bwt_dedup, html_extract, packing, quality_rules, ri_classifier, secret_index, simhash_golay, url_equiv, vector_graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.link_vectors(table(spark, sf_dir, "embeddings"))[0]


def vector_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recall of op2's graph: all links of the ids divisible by 20 with all vectors, and those that the graph lacked."""
    return vector_graph.link_vectors(table(spark, sf_dir, "embeddings"))[1]


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_golay.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_index.secret_report(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ri_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_equiv.judge_urls(table(spark, sf_dir, "pages"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html, op2_vectors, op3_repeats, op4_simhash, op5_secrets, op6_quality, op7_packing, op8_bpe, op9_urls, op10_rules, vector_audit, pipeline)}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
