"""Listings stored by page (F04, W07): any page is read as cheaply as the first.

Positions are worked out once from counts per (key, range), see ``sequence``, and the rows are stored in the order of
(page, key), in small row groups. Reading a page is a filter that the scan tests against the bounds of the
row groups, so it reads that page of every key and little else, however deep it lies.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sequence

PAGE = "_page"
ROW_GROUP_BYTES = 1 << 20


def store(rows: DataFrame, path: str, key: str, order: Sequence[Column], size: int = 10,
          row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write ``rows`` with their 1-based ``position`` in their key's listing, ``size`` to a page. ``order`` is
    a total order within a key; rows with a NULL key are in no listing."""
    placed = (sequence.with_index(rows, key, order, "position").withColumn("position", F.col("position") + 1)
              .withColumn(PAGE, F.ceil(F.col("position") / size).cast("bigint")))
    (placed.repartitionByRange(PAGE, key).sortWithinPartitions(PAGE, key, "position")
     .write.option("parquet.block.size", str(row_group_bytes)).parquet(path))


def read_pages(spark: SparkSession, path: str, first: int, last: int | None = None) -> DataFrame:
    """Rows on pages ``first`` to ``last`` (``first`` alone if not given) of every key's listing."""
    return spark.read.parquet(path).where(F.col(PAGE).between(first, first if last is None else last)).drop(PAGE)
