"""Corpus pipeline: five stages over documents, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontamination, linededup, pieces, simhash, toxicity
from quillstone.llm.lineage import cleared, mark, shared_folder, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; null and empty texts have no features and stay."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, every document stays; a column n_chars follows the text (null: null)."""
    kept = linededup.without_repeated_lines(docs)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays; null and empty texts are one group."""
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go; null and empty texts and rows without doc_id stay."""
    return decontamination.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces, lossless) of what is left; null and empty texts have no pieces."""
    return pieces.encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_representatives),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode_pieces),
]

#: A trained score and keyed hashes have no SQL; the tests hold each stage against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over sf_dir's documents."""
    shared_folder(spark)
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = mark()
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        cleared(spark, before, docs)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
