"""One query for each operator, over the whole table of documents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import (
    bpe,
    conversations,
    fingerprints,
    jaccard,
    lines,
    mixing,
    quality,
    runs,
    secret_scan,
    sharding,
    substrings,
    token_counts,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, d))


def op2_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.count_tokens(
        documents(spark, d), public_tokenizers.path("byte_bpe_50k.json"), max_tokens=512
    )


def op3_mixing(spark: SparkSession, d: str) -> DataFrame:
    target = mixing.Target(max_repeats=2.0)
    return mixing.mixed(documents(spark, d), target, block_tokens=1_000_000)


def op4_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.verdicts(documents(spark, d))


def op5_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    made = lines.deduplicated(documents(spark, d), min_docs=10, min_chars=1)
    return made.selectExpr(
        "cast(row.doc_id as bigint) as doc_id", "n_lines", "n_dropped",
        "sha2(kept_text, 256) as kept_sha256",
    )


def op6_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secret_scan.scan(documents(spark, d)).selectExpr(
        "doc_id", "word_no", "sha2(value, 256) as value_sha256", "score", "secret"
    )


HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)"


def op7_toxicity(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.read.parquet(f"{d}/labels.parquet").where(f"not {HELD_OUT}")
    model = toxicity.fit(documents(spark, d), labels)
    return toxicity.scored(documents(spark, d), model).selectExpr(
        "doc_id", f"{HELD_OUT} as held_out", "score", "if(score >= 0.3, 1, 0) as predicted"
    )


def op8_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, d), k=5, percent=75)


def op9_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(documents(spark, d), vocabulary, public_tokenizers.PATTERN)


def op10_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    made = substrings.without_repeats(documents(spark, d), length=35)
    return made.selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) as kept_sha256")


def op11_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(runs.planted(documents(spark, d))))


def op12_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    return conversations.repairs(conversations.turns(conversations.damaged(rows)))


def op13_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.sharded(documents(spark, d), shards=24).selectExpr(
        "doc_id", "size", "text_crc32", "'bytes' as law", "shard", "slot",
        "cast(null as int) as grown_shard",
    )


QUERIES: dict[str, Query] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_token_counts": op2_token_counts,
    "op3_mixing": op3_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_line_dedup": op5_line_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_sharding": op13_sharding,
}
