"""Corpus pipeline: language ID, near-duplicates, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written
as Parquet and read again before the next. All stages but the last return the columns of
``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from forumlens.llm.common import documents, prepared, written
from forumlens.llm.decontaminate import contamination
from forumlens.llm.language import UNKNOWN, held_out, identify_languages
from forumlens.llm.mixing import mixed_documents
from forumlens.llm.queries import vocabulary_path
from forumlens.llm.simhash import representatives
from forumlens.llm.token_files import token_digest, write_token_files
from forumlens.session import scratch_path
from forumlens.sources.tables import read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_SCORE = 0.1  # below this a text resembles no learned language


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts without letters, or like no language, go."""
    prepared(spark)
    docs = docs.select(*COLUMNS)
    found = identify_languages(docs, docs.where(~held_out()), keep=COLUMNS)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    prepared(spark)
    return representatives(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    prepared(spark)
    docs = docs.select(*COLUMNS)
    found = contamination(docs, read_table(spark, sf_dir, "benchmark"), text_hash=F.xxhash64("text"))
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    same = docs["doc_id"].eqNullSafe(hit["__id"]) & (F.xxhash64(docs["text"]) == hit["__hash"])
    return docs.join(hit, same, "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated as the mix of sources takes them."""
    prepared(spark)
    return mixed_documents(docs.select(*COLUMNS))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as token files; returns their digest read back from the files."""
    prepared(spark)
    return token_digest(write_token_files(docs, scratch_path(spark, "tokens"), vocabulary_path()))


STAGES = [
    ("language ID", language_id),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token files", token_output),
]
ORACLE_SQL = None  # fingerprints, profiles and token ids have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
