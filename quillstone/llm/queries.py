"""The registered queries of this subpackage, op<N>_<name>, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontamination, dialogues, licences, linededup, negatives, phrases, pieces, quality, rules, sharding, simhash, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.clustered(_table(spark, sf_dir, "documents"))


def op1_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_table(spark, sf_dir, "documents"))


def op6_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assigned(_table(spark, sf_dir, "documents"))


def op8_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = phrases.without_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.deduplicated(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", "longest_repeat", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.filtered(_table(spark, sf_dir, "documents")).drop("rejected_by")


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return dialogues.repaired(dialogues.damaged(conversations), conversations)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    noisy = _table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mined(noisy, F.col("vec_id") % 50 == 0)


def op13_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_discriminant": op1_quality_discriminant,
    "op2_weak_toxicity": op2_weak_toxicity,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_licence_scan": op4_licence_scan,
    "op5_merge_dropout": op5_merge_dropout,
    "op6_external_shuffle": op6_external_shuffle,
    "op7_quality_rules": op7_quality_rules,
    "op8_repeated_phrases": op8_repeated_phrases,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_warc_salvage": op13_warc_salvage,
}

ORACLE_SQL: dict[str, str] = {
    "op7_quality_rules": rules.SQL,
    "op8_repeated_phrases": phrases.SQL,
    "op9_line_dedup": linededup.SQL,
    "op11_conversation_repair": dialogues.SQL,
    "op12_hard_negatives": negatives.SQL,
    "op13_warc_salvage": warc.SQL,
}
