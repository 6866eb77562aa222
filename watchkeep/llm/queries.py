"""The text operators as queries over the given tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from watchkeep.llm import (
    decontamination, fill_in_middle, lm_scoring, mixing, near_dedup, packing, prefix_trie, quality_model, quality_rules, sharding,
    token_counts, toxicity, warc)
from watchkeep.llm.common import prepare, read
from watchkeep.llm.fill_in_middle_sql import FILL_IN_MIDDLE
from watchkeep.llm.mixing_sql import MIXING
from watchkeep.llm.prefix_trie_sql import PREFIX_TRIE
from watchkeep.llm.quality_rules_sql import QUALITY_RULES


def op1_warc(spark, folder: str) -> DataFrame:
    return warc.round_trip(read(prepare(spark), folder, "pages"))


def op2_toxicity(spark, folder: str) -> DataFrame:
    prepare(spark)
    return toxicity.toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op3_token_counts(spark, folder: str) -> DataFrame:
    return token_counts.token_counts(
        read(prepare(spark), folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op4_sharding(spark, folder: str) -> DataFrame:
    placed = sharding.bounded_ring(read(prepare(spark), folder, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op5_packing(spark, folder: str) -> DataFrame:
    return packing.pack(
        read(prepare(spark), folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op6_quality_rules(spark, folder: str) -> DataFrame:
    return quality_rules.line_rules(read(prepare(spark), folder, "documents")).drop("host", "content")


def op7_lm_scoring(spark, folder: str) -> DataFrame:
    return lm_scoring.log_scores(read(prepare(spark), folder, "documents"))


def op8_near_dedup(spark, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(read(prepare(spark), folder, "documents"), words=2)


def op9_decontamination(spark, folder: str) -> DataFrame:
    prepare(spark)
    return decontamination.leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op10_quality(spark, folder: str) -> DataFrame:
    prepare(spark)
    return quality_model.quality(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op11_mixing(spark, folder: str) -> DataFrame:
    _, account = mixing.mixture(read(prepare(spark), folder, "documents"))
    return account.select("doc_id", "size", "source_size", "target", "taken")


def op12_fill_in_middle(spark, folder: str) -> DataFrame:
    cut = fill_in_middle.fill_in_middle(read(prepare(spark), folder, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(fill_in_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_prefix_trie(spark, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(prepare(spark), folder, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_toxicity, op3_token_counts, op4_sharding, op5_packing, op6_quality_rules, op7_lm_scoring, op8_near_dedup,
    op9_decontamination, op10_quality, op11_mixing, op12_fill_in_middle, op13_prefix_trie)}
ORACLE: dict[str, str] = {
    "op6_quality_rules": QUALITY_RULES, "op11_mixing": MIXING, "op12_fill_in_middle": FILL_IN_MIDDLE, "op13_prefix_trie": PREFIX_TRIE}
