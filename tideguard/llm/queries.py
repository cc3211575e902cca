"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideguard.llm import (
    chat,
    identifiers,
    lines,
    merkle,
    mixing,
    packing,
    periods,
    quality,
    repeats,
    sharding,
    simhash,
    topk,
    vectors,
)
from tideguard.llm.common import table
from tideguard.session import scratch_path

SHARDS = 16
OLD_SHARDS = 12


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = lines.removed_lines(table(spark, sf_dir, "documents"))
    return removed.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op2_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_context_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.personal_data(table(spark, sf_dir, "documents"))


def ranks_file() -> str:
    """The public tokenizer's vocabulary: the ranks of byte_bpe_50k.json, the same ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), ranks_file())


def op5_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(table(spark, sf_dir, "documents"))


def op6_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op7_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op8_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op9_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "resharded")
    return sharding.reshard_documents(table(spark, sf_dir, "documents"), OLD_SHARDS, SHARDS, path)


def op10_prefix_interval_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("removed", "spans")


def op11_online_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periods.with_planted_runs(table(spark, sf_dir, "documents"))
    return periods.digests(periods.collapse_runs(docs))


def op12_cogrouped_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(table(spark, sf_dir, "documents")).drop("levels")


def op13_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_pca_tiles,
        op3_context_bootstrap,
        op4_sum_of_squares_packing,
        op5_host_quality,
        op6_perspective_rotation,
        op7_pivot_simhash,
        op8_fair_queue_mix,
        op9_flow_reshard,
        op10_prefix_interval_repeats,
        op11_online_periodic_runs,
        op12_cogrouped_merkle,
        op13_segment_topk,
    )
}
