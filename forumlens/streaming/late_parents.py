"""Replies whose parent is scraped after them (D12 on a stream).

Scraped rows land as Parquet files: ``comment_id``, ``parent_comment_id`` (the id that the page links
to, NULL for none), ``usable`` (whether the row may be a parent) and ``scraped_time``. Two streams
run one after the other, each over what is new to it:

* ``store``: every row is stored, its id goes into a key index, and replies whose parent the index
  holds get their link at once. The others are handed on as waiting.
* ``wait``: a stream-stream left outer join of the waiting replies with the rows stored after them.
  A reply stays in the state store until its parent comes or the watermark is ``wait`` past it; then
  the index is asked once more, and a reply without a parent is reported as missing.

A batch arrives at the latest ``scraped_time`` seen so far, so arrival never runs backwards, no
row is late for the watermark, and a stored row stays in the state only until the next arrival.
Every batch also hands on one row without ids, so time passes for both sides of the join when nothing waits.
Replies of one parent are spread over ``SALTS`` keys. The (parent, salt) pairs at which replies wait are kept in a
second key index, and a stored row is handed to the join only at its pairs, so the state holds no more
rows than replies that wait. A number ``salts`` instead hands every stored row to each of so many keys. Folders are numbered by batch and a retry
overwrites its own; ids indexed twice by a retry change nothing.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import key_index

SCRAPED = "comment_id long, parent_comment_id long, usable boolean, scraped_time timestamp"
ROW = "comment_id long, parent_comment_id long, usable boolean, seen timestamp, _batch long"
REPLY = "comment_id long, parent_comment_id long, seen timestamp, _batch long"
WANTED = "comment_id long, salt int"
PARENT = "comment_id long, salt int, seen timestamp, _batch long"
ID = ["comment_id"]
WAIT = "30 days"
SLACK = "1 minute"     # keeps rows of the newest arrival on the near side of the watermark
SALTS = 8


@dataclass(frozen=True)
class Threads:
    """Folders of one sink."""

    path: str

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.path}/checkpoint-{name}"


def create(spark: SparkSession, sink: Threads) -> None:
    """Empty tables, once: afterwards a read error is an error."""
    for name, schema in (("rows", ROW), ("waiting", REPLY), ("parents", PARENT), ("links", REPLY), ("late", REPLY),
                         ("missing", REPLY)):
        (spark.createDataFrame([], schema).drop("_batch").write.mode("ignore")
         .parquet(f"{sink.folder(name)}/_batch=-1"))
    for name, schema in (("ids", "comment_id long"), ("wanted", WANTED)):
        if not _exists(spark, sink.folder(name)):
            key_index.append_rows(spark.createDataFrame([], schema), sink.folder(name), ID)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _write(df: DataFrame, sink: Threads, name: str, number: int) -> None:
    df.write.mode("overwrite").parquet(f"{sink.folder(name)}/_batch={number}")


def _by_index(spark: SparkSession, replies: DataFrame, sink: Threads, how: str) -> DataFrame:
    """``replies`` whose parent the index holds (``left_semi``) or lacks (``left_anti``)."""
    asked = replies.select(F.col("parent_comment_id").alias("comment_id")).select("*", *key_index.key_hashes(ID))
    held = key_index.candidates(spark, sink.folder("ids"), asked, ID).select(F.col("comment_id").alias("_id"))
    return replies.join(held, replies["parent_comment_id"] == held["_id"], how)


def _salt(salts: int) -> Column:
    return F.pmod(F.xxhash64("comment_id"), F.lit(salts)).cast("int")


def _wanted(spark: SparkSession, rows: DataFrame, sink: Threads) -> DataFrame:
    """Usable rows for which replies wait, once for each salt of such replies."""
    usable = rows.where("usable AND comment_id IS NOT NULL").select("comment_id", "seen")
    asked = usable.select("comment_id", *key_index.key_hashes(ID))
    held = key_index.candidates(spark, sink.folder("wanted"), asked, ID, more=["salt"]).select(
        F.col("comment_id").alias("_id"), "salt")
    return usable.join(held, usable["comment_id"] == held["_id"]).select("comment_id", "salt", "seen").distinct()


def store_batch(spark: SparkSession, batch: DataFrame, number: int, sink: Threads) -> None:
    """Store one micro-batch, link the replies whose parent is known, hand on the others."""
    earlier = (spark.read.schema(REPLY).parquet(sink.folder("waiting")).where(F.col("_batch") < number)
               .agg(F.max("seen").alias("at")))
    arrival = batch.agg(F.max("scraped_time").alias("at")).union(earlier).agg(F.max("at").alias("seen"))
    stamped = batch.crossJoin(F.broadcast(arrival))  # one row
    _write(stamped.select("comment_id", "parent_comment_id", "usable", "seen"), sink, "rows", number)
    rows = spark.read.schema(ROW).parquet(f"{sink.folder('rows')}/_batch={number}").drop("_batch")
    key_index.append_rows(rows.where("usable").select(*ID), sink.folder("ids"), ID)
    replies = (rows.where("comment_id IS NOT NULL AND parent_comment_id IS NOT NULL")
               .select("comment_id", "parent_comment_id", "seen"))
    _write(_by_index(spark, replies, sink, "left_semi"), sink, "links", number)
    tick = arrival.select(F.lit(None).cast("long").alias("comment_id"),
                          F.lit(None).cast("long").alias("parent_comment_id"), "seen")
    # Asked before this batch's own pairs are added: its replies are linked to its rows by the index.
    # The time row of this side has an id, as a NULL would be dropped before the watermark, at a salt no reply has.
    time = tick.select(F.lit(0).cast("long").alias("comment_id"), F.lit(-1).alias("salt"), "seen")
    _write(_wanted(spark, rows, sink).unionByName(time), sink, "parents", number)
    _write(_by_index(spark, replies, sink, "left_anti").unionByName(tick), sink, "waiting", number)
    waiting = spark.read.schema(REPLY).parquet(f"{sink.folder('waiting')}/_batch={number}").where("comment_id IS NOT NULL")
    key_index.append_rows(waiting.select(F.col("parent_comment_id").alias("comment_id"), _salt(SALTS).alias("salt")).distinct(),
                          sink.folder("wanted"), ID)


def waiting_pairs(spark: SparkSession, sink: Threads, wait: str = WAIT, salts: int | None = None) -> DataFrame:
    """Streaming join: waiting replies with ``found``, the parent that came, or NULL once the wait is over."""
    waiting = (spark.readStream.schema(REPLY).parquet(sink.folder("waiting")).drop("_batch")
               .withWatermark("seen", SLACK).withColumn("salt", _salt(salts or SALTS)))
    if salts is None:
        parents = spark.readStream.schema(PARENT).parquet(sink.folder("parents")).withColumnRenamed("salt", "found_salt")
    else:
        parents = (spark.readStream.schema(ROW).parquet(sink.folder("rows")).where("usable")
                   .withColumn("found_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    parents = (parents.select(F.col("comment_id").alias("found"), "found_salt", F.col("seen").alias("found_seen"))
               .withWatermark("found_seen", SLACK))
    return waiting.join(parents, (F.col("parent_comment_id") == F.col("found")) & (F.col("salt") == F.col("found_salt"))
                        & (F.col("found_seen") >= F.col("seen"))
                        & (F.col("found_seen") <= F.col("seen") + F.expr(f"INTERVAL {wait}")), "left_outer"
                        ).select("comment_id", "parent_comment_id", "seen", "found")


def settle_batch(spark: SparkSession, pairs: DataFrame, number: int, sink: Threads) -> None:
    """Write the links of one micro-batch and the replies whose wait ended without a parent."""
    pairs = pairs.where("comment_id IS NOT NULL").persist()
    try:
        over = pairs.where("found IS NULL").drop("found")
        came = pairs.where("found IS NOT NULL").drop("found")
        _write(came.unionByName(_by_index(spark, over, sink, "left_semi")), sink, "late", number)
        _write(_by_index(spark, over, sink, "left_anti"), sink, "missing", number)
    finally:
        pairs.unpersist()


def run(spark: SparkSession, source: str, path: str, wait: str = WAIT, salts: int | None = None,
        files_per_trigger: int = 100) -> list[dict]:
    """Process every file in ``source`` not yet seen, then stop. Returns the progress of the waiting stream."""
    sink = Threads(path)
    create(spark, sink)
    scraped = spark.readStream.schema(SCRAPED).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    store = (scraped.writeStream.foreachBatch(lambda df, n: store_batch(df.sparkSession, df, n, sink))
             .option("checkpointLocation", sink.checkpoint("store")).trigger(availableNow=True).start())
    store.awaitTermination()
    settle = (waiting_pairs(spark, sink, wait, salts).writeStream.outputMode("append")
              .foreachBatch(lambda df, n: settle_batch(df.sparkSession, df, n, sink))
              .option("checkpointLocation", sink.checkpoint("wait")).trigger(availableNow=True).start())
    settle.awaitTermination()
    return settle.recentProgress


def read_missing(spark: SparkSession, path: str) -> DataFrame:
    """Replies whose wait ended without a parent."""
    return spark.read.schema(REPLY).parquet(Threads(path).folder("missing")).drop("_batch", "seen").distinct()


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    """Every stored comment once, with its parent's id or NULL while none is known.

    A comment scraped several times has the smallest parent that was found for it."""
    sink = Threads(path)
    ids = spark.read.schema(ROW).parquet(sink.folder("rows")).where("comment_id IS NOT NULL").select(
        "comment_id", F.lit(None).cast("long").alias("parent_comment_id"))
    links = [spark.read.schema(REPLY).parquet(sink.folder(name)).select("comment_id", "parent_comment_id")
             for name in ("links", "late")]
    every = ids.unionByName(links[0]).unionByName(links[1])
    return every.groupBy("comment_id").agg(F.min("parent_comment_id").alias("parent_comment_id"))
