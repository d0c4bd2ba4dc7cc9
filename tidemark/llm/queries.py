"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import compaction, embedding_dedup, filter_audit, html_extraction, lm_scoring, mixing, packing, quality_classifier, quality_rules, simhash, suffix_dedup, url_filters, vector_codes
from tidemark.llm.common import scratch, table


def byte_bpe() -> str:
    """The tokenizer's file, by the name that the packing contract gives."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe())


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality_classifier.classify(docs, table(spark, sf_dir, "labels"), keep_text=False)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op5_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends all documents as small shards, compacts them, and tells each document's shard."""
    store = compaction.ShardStore(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex}")
    store.append(table(spark, sf_dir, "documents"))
    version = store.compact()
    rows = store.read(version)
    if store.manifest(version).isEmpty():
        return rows.select("doc_id", F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(version).alias("version"))
    return rows.select("doc_id", F.substring_index(compaction.shard_of(rows), "/", -2).alias("shard"), compaction.shard_bytes_of(rows).alias("shard_bytes"), F.lit(version).alias("version"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """The first ten have none: they are tested against brute force."""
    return {"op11_filter_audit": filter_audit.SQL, "op12_url_filters": url_filters.SQL, "op13_vector_codes": vector_codes.SQL}
