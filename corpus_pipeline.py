"""A corpus pipeline of five stages over the table documents; each stage works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs. All
stages but the last return the columns of documents. ORACLE_SQL is None: trained models, fingerprints and packing are not
expressible in SQL; tests/llm holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import decontam, langid, neardup, packing, queries, secrets
from maskwright.llm.rows import reserved
from maskwright.llm.store import discard, materialize

#: a language is only believed from this calibrated probability on; documents below it are rejected
LEAST_SCORE = 0.3

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; texts that are null, without letters or below LEAST_SCORE go."""
    found = langid.identify(docs, queries.language_model(docs), fields=reserved(langid.FIELDS))
    return found.where((F.col("_mw_lang_pred") != langid.UNKNOWN) & (F.col("_mw_score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near duplicates: that of the smallest id, rows without one last.

    Candidates are documents whose SimHash fingerprints lie within 3 bits, by covering LSH, and for similar ones beyond
    them documents that share a MinHash band; a 5-word Jaccard of 0.8 or more, checked exactly, makes a link.
    """
    return neardup.distinct_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of texts; documents of which half the words or more are such go."""
    clean = decontam.removed(docs, queries.table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return _counted(clean, docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by a mark; every document stays."""
    return _counted(secrets.redact(docs), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4096 tokens."""
    return packing.pack_documents(docs, queries.tokenizer_path(), queries.SEQUENCE_TOKENS, queries.END_ID)


def _counted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in changed.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
