"""One query per operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontam, embed_dedup, langid, licenses, packing, ppm, sampling, simhash, tokenfile, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(fold: int) -> Column:
    """Whether the row's fold is left out of learning; rows without id are never learned from."""
    return F.coalesce(sampling.fold("doc_id") == fold, F.lit(True)).alias("held_out")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = licenses.scan_rows(docs.select("doc_id", "text"), licenses.train(docs))
    families = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"])))
    best = F.coalesce(F.array_max(F.transform("licenses", lambda x: x["probability"])), F.lit(0.0))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licensed"), F.array_join(families, ",").alias("families"), best.alias("score"))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify_rows(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", _held_out(0), "lang_pred", F.col("lang_score").alias("score"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = decontam.find(docs.select("doc_id", "text"), items)
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), F.array_join(ids.cast("array<string>"), ",").alias("items"), F.array_min(F.transform("matches", lambda m: m["distance"])).alias("least_distance"))


def op8_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = ppm.score(docs, ppm.learned(docs))
    return found.select("*", _held_out(1))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", _held_out(0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_warc_archive": op2_warc_archive,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_language_id": op4_language_id,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_token_files": op6_token_files,
    "op7_decontamination": op7_decontamination,
    "op8_ppm_scores": op8_ppm_scores,
    "op9_toxicity": op9_toxicity,
    "op10_best_fit_packing": op10_best_fit_packing,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op2_warc_archive": warc.ORACLE, "op3_embedding_dedup": embed_dedup.ORACLE}
