"""First-write-wins inserts into a stored table through an index on its natural key.

The table is Parquet with two more columns, a 128-bit hash of the key in two halves. Rows are
written in ranges of the first half, sorted, in small row groups that carry the half's bounds and a
Bloom filter. A batch of at most ``LITERAL_KEYS`` distinct keys is looked up by an IN filter on its
hashes, which the scan tests against bounds and Bloom filters, so it reads only the row groups
that may hold a key; a larger batch is joined on the hashes. Either way a hit counts only if the key
columns are equal. An insert appends the rows it adds and rewrites nothing.

Rows with a NULL in the key never conflict and are all added. Two keys of a batch share both halves of the
hash with odds of about n * n / 2 ** 129.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HIGH, LOW = "_key_high", "_key_low"
LITERAL_KEYS = 1_000
ROW_GROUP_BYTES = 1 << 20
IN_THRESHOLD = "spark.sql.parquet.pushdown.inFilterThreshold"


def key_hashes(keys: list[str]) -> list[Column]:
    """Both halves of the hash of a key; NULL if a key column is."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return [F.when(known, F.xxhash64(F.lit(salt), *keys)).alias(name) for salt, name in ((1, HIGH), (2, LOW))]


def append_rows(rows: DataFrame, path: str, keys: list[str], row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Add rows to the table at ``path`` (created if there is none)."""
    (rows.select("*", *key_hashes(keys)).repartitionByRange(HIGH, LOW).sortWithinPartitions(HIGH, LOW)
     .write.mode("append")
     .option(f"parquet.bloom.filter.enabled#{HIGH}", "true")
     .option("parquet.bloom.filter.adaptive.enabled", "true")
     .option("parquet.block.size", str(row_group_bytes))
     .parquet(path))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows without their hashes."""
    return spark.read.parquet(path).drop(HIGH, LOW)


def candidates(spark: SparkSession, path: str, wanted: DataFrame, keys: list[str],
               literal_keys: int = LITERAL_KEYS, more: Sequence[str] = ()) -> DataFrame:
    """Stored keys, hashes and columns ``more`` that may equal one of ``wanted`` (with hash columns): all the equal ones
    are among them."""
    stored = spark.read.parquet(path).select(HIGH, LOW, *keys, *more)
    asked = wanted.where(F.col(HIGH).isNotNull()).select(HIGH).distinct()
    few = [r[0] for r in asked.limit(literal_keys + 1).collect()]  # ``literal_keys`` numbers
    if len(few) > literal_keys:
        return stored.where(F.col(HIGH).isNotNull())
    if int(spark.conf.get(IN_THRESHOLD)) < literal_keys:
        spark.conf.set(IN_THRESHOLD, str(literal_keys))  # beyond it the scan tests only the least and largest value
    return stored.where(F.col(HIGH).isin(few) if few else F.lit(False))


def new_rows(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], order: list[str],
             literal_keys: int = LITERAL_KEYS) -> DataFrame:
    """Rows of ``batch`` that collide neither with a stored row nor with an earlier batch row by ``order``."""
    hashed = batch.select("*", *key_hashes(keys))
    known = hashed.where(F.col(HIGH).isNotNull())
    first = (known.groupBy(HIGH, LOW).agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("_r"))
             .select("_r.*", HIGH, LOW))
    stored = candidates(spark, path, hashed, keys, literal_keys)
    same = [first[c] == stored[c] for c in (HIGH, LOW, *keys)]
    return first.join(stored, same, "left_anti").select(*batch.columns).unionByName(
        hashed.where(F.col(HIGH).isNull()).select(*batch.columns))


def insert(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], order: list[str],
           literal_keys: int = LITERAL_KEYS) -> None:
    """Append the new rows of ``batch`` to the table at ``path``."""
    append_rows(new_rows(spark, path, batch, keys, order, literal_keys), path, keys)
