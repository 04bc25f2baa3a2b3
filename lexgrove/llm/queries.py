"""Queries of the operators in this subpackage, over the tables of a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm import chat, line_dedup, media, mixing, near_dedup, neighbours, packing, quality, toxicity, warc
from lexgrove.llm.scratch import shared_folder

#: Weights of the Efraimidis-Spirakis keys for documents labelled good and bad.
GOOD, BAD = 2.0, 0.5


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def quality_weights(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, quality): the weight of each labelled document."""
    labels = table(spark, folder, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    return labels.select(F.col("doc_id").alias("_id"), F.when(F.col("label") > 0, GOOD).when(F.col("label") == 0, BAD).alias("quality"))


def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), percent=85)


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    sizes = table(spark, folder, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    weights = quality_weights(spark, folder)
    weighted = sizes.join(weights, sizes["doc_id"] == weights["_id"], "left").drop("_id")
    return mixing.mixed(weighted, quality="quality").select("doc_id", "size", "source_size", "target", "taken")


def op3_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


def op4_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_shared_lines(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, folder, "documents"))


def op7_media_columns(spark: SparkSession, folder: str) -> DataFrame:
    return media.media_digests(table(spark, folder, "documents"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    archives = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, folder, "pages"), archives)
    return warc.read_archives(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_chat_roles(spark: SparkSession, folder: str) -> DataFrame:
    return chat.roles(table(spark, folder, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_duplicates": near_dedup.ORACLE, "op6_shared_lines": line_dedup.ORACLE, "op9_warc_archives": warc.ORACLE}
