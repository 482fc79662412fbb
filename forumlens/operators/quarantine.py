"""Quarantine split: rows whose number, time or foreign key cannot be used are
kept aside with a reason instead of being silently dropped."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import normalize_count, normalize_time


def split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with a ``reason`` column); ``reason`` is NULL for good rows."""
    tagged = df.withColumn("reason", reason)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def number_reason(text: str) -> Column:
    return F.when(F.col(text).isNotNull() & normalize_count(text).isNull(), F.lit("bad_number"))


def time_reason(text: str, base: str) -> Column:
    return F.when(F.col(text).isNotNull() & normalize_time(text, base).isNull(), F.lit("bad_time"))


def missing_key_reason(df: DataFrame, key: str, parent: DataFrame, parent_key: str,
                       reason: str = "missing_article") -> DataFrame:
    """Rows of ``df`` whose ``key`` is NULL or absent from ``parent`` (an anti-join)."""
    known = parent.select(F.col(parent_key).alias(key))
    absent = df.join(known, key, "left_anti")
    return absent.withColumn("reason", F.lit(reason))


def report(number_rows: DataFrame, time_rows: DataFrame, comments: DataFrame,
           articles: DataFrame) -> DataFrame:
    """(source, id, reason) for every unusable row of the three inputs."""
    _, bad_num = split(number_rows, number_reason("number_text"))
    _, bad_time = split(time_rows, time_reason("time_text", "base_time"))
    bad_fk = missing_key_reason(comments.select("comment_id", "article_id"), "article_id",
                                articles, "article_id")
    return (bad_num.select(F.lit("number_text").alias("source"), "id", "reason")
            .unionByName(bad_time.select(F.lit("time_text").alias("source"), "id", "reason"))
            .unionByName(bad_fk.select(F.lit("comments").alias("source"),
                                       F.col("comment_id").alias("id"), "reason")))
