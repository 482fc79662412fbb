"""Stored tables in parts: a change reads and rewrites only the parts that it hits.

A table is Parquet in folders ``_part=n``, n a hash of its key modulo the number of parts; choose it
so that a part is some hundred MB. Two kinds of change:

* ``add_sums`` (B03, E06): per-key sums kept as partial aggregation state. A batch is summed by key, and its
  sums are added to the stored ones; nothing is counted again.
* ``update`` (B02): present attributes of matched rows overwritten. Which batch row counts for a key, and
  which keys the table holds, is worked out from keys and row addresses; texts are read only
  for the rows that change and for the parts that hold them.

Parts are replaced by a dynamic partition overwrite: lost tasks and executors are worked out again before anything is
replaced, and parts that a batch does not hit keep their files. A driver lost during the commit may leave some
parts replaced and others not: every row of ``add_sums`` has the number of the last batch of its part, so
a retry adds a batch only where it is missing, and an update may be repeated as it is. The commit is not
atomic: for the part being moved at that moment, the old folder may be gone and the new one still in
the job's ``.spark-staging`` folder. Move it from there before a retry, which would take the part as empty.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART, APPLIED = "_part", "_applied"


def part_of(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def write(rows: DataFrame, path: str, keys: list[str], parts: int, mode: str = "errorifexists") -> None:
    """Store ``rows`` in parts by ``keys``; a part of several tasks' size is written as several files."""
    (rows.withColumn(PART, part_of(keys, parts)).hint("rebalance", F.col(PART))
     .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows."""
    return spark.read.parquet(path).drop(PART, APPLIED)


def _hit(rows: DataFrame) -> list[int]:
    """Numbers of the parts of ``rows``: at most as many as the table has parts."""
    return [r[0] for r in rows.select(PART).distinct().collect()]


def create_sums(spark: SparkSession, path: str, keys: str, sums: list[str]) -> None:
    """An empty table of sums; ``keys`` are typed columns as in a schema text."""
    schema = ", ".join([keys, *[f"{c} bigint" for c in sums], f"{APPLIED} bigint"])
    spark.createDataFrame([], schema).write.parquet(f"{path}/{PART}=-1")


def add_sums(delta: DataFrame, path: str, keys: list[str], sums: list[str], number: int, parts: int) -> None:
    """Add ``delta`` (rows with ``keys`` and integer ``sums``; NULL counts as 0) as batch ``number``.

    Numbers ascend; a batch that a part has already is not added to it again. A NULL key is a key of its own."""
    spark = delta.sparkSession
    asked = (delta.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in sums])
             .withColumn(PART, part_of(keys, parts)))
    hit = _hit(delta.select(part_of(keys, parts).alias(PART)))
    stored = spark.read.parquet(path).where(F.col(PART).isin(hit))
    done = [r[0] for r in stored.where(F.col(APPLIED) >= number).select(PART).distinct().collect()]
    open_parts = [p for p in hit if p not in set(done)]
    if not open_parts:
        return
    both = (stored.select(*keys, *sums, PART).unionByName(asked)).where(F.col(PART).isin(open_parts))
    merged = both.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in sums])
    write(merged.withColumn(APPLIED, F.lit(number).cast("bigint")), path, keys, parts, "overwrite")


def update(batch: DataFrame, path: str, batch_path: str, key: str, cols: list[str], order: str, parts: int) -> None:
    """Overwrite ``cols`` of stored rows with the present (non-NULL) values of the first batch row by ``order``
    that has their ``key``. Batch rows without a stored row, or with a NULL key, are ignored.

    The batch is written to ``batch_path`` (a new folder), so that its rows have addresses."""
    spark = batch.sparkSession
    batch.select(key, F.col(order).alias("_order"), *cols).write.parquet(batch_path)
    sent = spark.read.parquet(batch_path)
    at = F.struct("_metadata.file_path", "_metadata.row_index")
    first = (sent.where(F.col(key).isNotNull()).select(key, F.struct("_order", at.alias("at")).alias("_first"))
             .groupBy(key).agg(F.min("_first").alias("_first")))
    held = spark.read.parquet(path).select(F.col(key).alias("_key"))
    winners = first.join(held, first[key] == held["_key"], "left_semi").select(
        F.col("_first.at").alias("_at"), part_of([key], parts).alias(PART))
    winners.write.parquet(f"{batch_path}-winners")
    winners = spark.read.parquet(f"{batch_path}-winners")
    hit = _hit(winners)
    if not hit:
        return
    texts = sent.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols], at.alias("_at"))
    changes = texts.join(winners.select("_at"), "_at", "left_semi").drop("_at")
    target = spark.read.parquet(path).where(F.col(PART).isin(hit)).drop(PART)
    joined = target.join(changes, key, "left")
    new = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in cols}
    write(joined.select(*[new.get(c, F.col(c)).alias(c) for c in target.columns]), path, [key], parts, "overwrite")
