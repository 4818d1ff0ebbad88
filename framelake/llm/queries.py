"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import decontaminate, lines, mixing, preference, toxicity
from framelake.llm.multiindex import near_vectors
from framelake.llm.ngram import score, train
from framelake.llm.pii import pii_digest, scan_pii
from framelake.llm.secrets import scan_secrets, secrets_digest
from framelake.llm.shared import id_crc, table
from framelake.llm.simhash import simhash_groups


def op1_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_crc(F.col("doc_id")) % 10 == 0
    return score(docs, train(docs.where(~held_out)), extra={"held_out": held_out})


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_crc(F.col("doc_id")) % 4 == 2
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), use=~held_out)
    scored = toxicity.with_scores(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(scan_pii(table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(scan_secrets(table(spark, sf_dir, "documents")))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = preference.conversations_as_arrays(table(spark, sf_dir, "conversations"))
    return preference.format_preferences(preference.pair_by_first_turn(conversations))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram": op1_ngram,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_pii": op4_pii,
    "op5_decontamination": op5_decontamination,
    "op6_secrets": op6_secrets,
    "op7_embeddings": op7_embeddings,
    "op8_line_dedup": op8_line_dedup,
    "op9_simhash": op9_simhash,
    "op10_preference": op10_preference,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op10_preference": preference.ORACLE,
}
