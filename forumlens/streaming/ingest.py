"""Incremental comment ingest with Structured Streaming.

New comment batches land as Parquet files in a source folder, with counts and posted times
as scraped texts. Each run (``trigger(availableNow=True)``) takes the files not yet seen, some
at a time, and per micro-batch

* normalises the texts; rows with an unusable count or time go to ``quarantine`` with a reason;
* inserts the rest with first-write-wins on the natural key.

The sink keeps ``rows`` and, apart from them, ``keys``: only ids and natural keys (the content
as a hash), partitioned by blocks of articles. A crawl's batch holds few articles, so only
their blocks of the key table are read. Everything a micro-batch writes goes to folders of its
own number, which a retry of the same batch overwrites, and it is compared with the keys of
other batches only, so retries and re-runs add nothing.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.normalize import normalize_count, normalize_time
from ..operators import maintain, quarantine

KEY = ["article_id", "user_link", "comment_content"]
KEY_COLUMNS = "comment_id long, article_id long, user_link string, content_hash string, _block long, _batch long"
ARTICLES_PER_BLOCK = 1_000
FILES_PER_TRIGGER = 100
MAX_PRUNED_BLOCKS = 500   # beyond, the block is a join key only


@dataclass(frozen=True)
class Sink:
    """Folders of one sink."""

    path: str

    @property
    def rows(self) -> str:
        return f"{self.path}/rows"

    @property
    def keys(self) -> str:
        return f"{self.path}/keys"

    @property
    def quarantine(self) -> str:
        return f"{self.path}/quarantine"


def normalized(batch: DataFrame) -> DataFrame:
    """Scraped texts as values: ``agreements_count`` and ``normalized_posted_time``, with a
    ``reason`` where one of them is unusable."""
    reason = F.coalesce(quarantine.number_reason("agreements_text"),
                        quarantine.time_reason("posted_text", "scraped_time"))
    return (batch.withColumn("reason", reason)
            .withColumn("agreements_count", normalize_count("agreements_text"))
            .withColumn("normalized_posted_time", normalize_time("posted_text", "scraped_time")))


def _null_key():
    return F.col("article_id").isNull() | F.col("user_link").isNull() | F.col("comment_content").isNull()


def _earlier_keys(spark: SparkSession, sink: Sink, number: int, blocks: list[int]) -> DataFrame:
    found = spark.read.schema(KEY_COLUMNS).parquet(sink.keys).where(F.col("_batch") != number)
    return found.where(F.col("_block").isin(blocks)) if len(blocks) <= MAX_PRUNED_BLOCKS else found


def insert_batch(spark: SparkSession, batch: DataFrame, number: int, sink: Sink, order: str = "comment_id",
                 articles_per_block: int = ARTICLES_PER_BLOCK) -> None:
    """First-write-wins insert of one micro-batch into the sink."""
    block = F.coalesce(F.floor(F.col("article_id") / articles_per_block), F.lit(-1))
    rows = (normalized(batch).withColumn("_block", block).withColumn("_batch", F.lit(number).cast("long"))
            .withColumn("content_hash", F.sha2("comment_content", 256)).persist())
    try:
        blocks = [r[0] for r in rows.select("_block").distinct().limit(MAX_PRUNED_BLOCKS + 1).collect()]
        good, bad = rows.where(F.col("reason").isNull()), rows.where(F.col("reason").isNotNull())
        seen = _earlier_keys(spark, sink, number, blocks)
        fresh = maintain.first_per_key(good.drop("reason"), KEY, [order])
        key = ["_block", "article_id", "user_link", "content_hash"]
        keyed = fresh.where(~_null_key()).join(seen.select(*key), key, "left_anti")
        # Rows whose key has a NULL never collide by key; their id keeps them from coming twice.
        loose = fresh.where(_null_key()).join(seen.select("_block", order), ["_block", order], "left_anti")
        added = keyed.unionByName(loose)
        _write(added.drop("content_hash", "_block"), sink.rows, number)
        written = spark.read.schema(added.schema).parquet(f"{sink.rows}/_batch={number}")
        _write(written.withColumn("_block", block).withColumn("content_hash", F.sha2("comment_content", 256))
               .select("comment_id", "article_id", "user_link", "content_hash", "_block"), sink.keys, number, "_block")
        _write(bad.select(order, "agreements_text", "posted_text", "reason"), sink.quarantine, number)
    finally:
        rows.unpersist()


def _write(df: DataFrame, path: str, number: int, *by: str) -> None:
    df.drop("_batch").write.mode("overwrite").partitionBy(*by).parquet(f"{path}/_batch={number}")


def create_sink(spark: SparkSession, sink: Sink) -> None:
    """Empty key table, once: afterwards a read error is an error, never an empty sink."""
    spark.createDataFrame([], KEY_COLUMNS).drop("_block", "_batch").write.mode("ignore").parquet(f"{sink.keys}/_batch=-1/_block=-1")


def read_sink(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(Sink(sink).rows).drop("_batch")


def run_ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: StructType,
               files_per_trigger: int = FILES_PER_TRIGGER) -> None:
    """Process every file in ``source`` not yet seen, then stop."""
    to = Sink(sink)
    create_sink(spark, to)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    q = (stream.writeStream
               .foreachBatch(lambda df, number: insert_batch(spark, df, number, to))
               .option("checkpointLocation", checkpoint)
               .trigger(availableNow=True)
               .start())
    q.awaitTermination()
