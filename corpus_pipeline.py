"""Corpus preparation: five stages over ``documents``, each written as Parquet and read again by the next.

Language ID drops documents without a recognisable language, toxicity drops toxic ones, SimHash keeps
one document of each near-duplicate group, decontamination drops documents that hold a benchmark
passage, and packing places what is left in sequences.

All stages take whole texts, however long. Repeated rows and rows without id go through them like any
others, but that near-duplicate detection leaves one row of each group; columns that bear names the
operators use inside, such as ``score`` or ``matches``, are replaced by the operators and so do not belong
in ``documents``; an empty table passes every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontam, langid, packing, simhash, toxicity
from cadenza.llm.workspace import Workspace

#: A document whose best language has a lower mean probability over its words is rejected.
LEAST_LANGUAGE_SCORE = 0.4

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters, null and empty ones among them, and texts in which no language prevails; a score at the limit stays."""
    found = langid.identify_rows(docs, langid.train(docs))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored 0.5 or more by models of the labelled rows among these documents; without labels of both classes nothing is told apart."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_rows(docs, model).where(F.col("score") < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group whose five-word shingles are 0.8 alike or more; texts without words form one group."""
    return simhash.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a passage within the edit budget of a benchmark item; null and empty texts and items match nothing."""
    found = decontam.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("matches") == 0).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; a null or empty text is one piece, its end id."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: Trained models, hashes and tokenisers are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"{number}-{name}")
        if number:
            ws.drop(f"{number - 1}-{STAGES[number - 1][0]}")
    return docs
