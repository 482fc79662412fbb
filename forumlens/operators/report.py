"""Evaluation tables, long-form series and the nested export."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A


def squared_error(pred, target, d: int | None = None):
    """Sum over components of (pred - target)^2."""
    p, t = (F.col(c) if isinstance(c, str) else c for c in (pred, target))
    if d:
        return A._sum([(p[i] - t[i]) * (p[i] - t[i]) for i in range(d)])
    return A.total(F.zip_with(p, t, lambda a, b: (a - b) * (a - b)))


def errors_by(rows: DataFrame, keys: list[str], dim: int = 3) -> DataFrame:
    """MSE (mean over rows and components) and SSE per group, and the SSE of the
    discretised prediction (N01, E08, E09)."""
    return (rows.groupBy(*keys)
                .agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("sq").alias("_s"), F.sum("sq_discrete").alias("_d"))
                .select(*keys, "n_pairs", F.round(F.col("_s") / (dim * F.col("n_pairs")), 6).alias("mse"),
                        F.round("_s", 6).alias("sse"), F.round("_d", 6).alias("sse_discrete")))


def epoch_loss(rows: DataFrame, key: str, idx: str, batch: int, dim: int = 3) -> DataFrame:
    """Mean of per-batch mean losses (E10): two partial aggregations."""
    per_batch = (rows.groupBy(key, F.floor(F.col(idx) / batch).alias("batch"))
                     .agg(F.avg(F.col("sq") / dim).alias("batch_loss")))
    return per_batch.groupBy(key).agg(F.count(F.lit(1)).alias("n_batches"),
                                      F.round(F.avg("batch_loss"), 6).alias("epoch_loss"))


def long_form(wide: DataFrame, ids: list[str], series: list[str]) -> DataFrame:
    """Columns ``series`` stacked into (series, value) rows."""
    pairs = ", ".join(f"'{s}', `{s}`" for s in series)
    return wide.select(*ids, F.expr(f"stack({len(series)}, {pairs}) AS (series, value)")) \
               .withColumn("value", F.round("value", 6))


EXPORT_CHUNK = 1000  # steps per exported record, keeps each record bounded


def export_nested(nodes: DataFrame, path: str, metadata: dict) -> None:
    """Write ``{metadata}`` once and the data as JSON records
    ``{node_id, chunk, data: [{k, state}, ...]}`` sorted by k (B06). A node with
    many steps spans several records instead of one unbounded array."""
    spark = nodes.sparkSession
    recs = (nodes.groupBy("node_id", F.floor(F.col("k") / EXPORT_CHUNK).alias("chunk"))
                 .agg(F.array_sort(F.collect_list(F.struct("k", "state"))).alias("data")))
    recs.write.mode("overwrite").json(f"{path}/data")
    spark.createDataFrame([(json.dumps(metadata),)], "metadata string") \
         .write.mode("overwrite").text(f"{path}/metadata")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    schema = "node_id bigint, chunk bigint, data array<struct<k:int, state:array<double>>>"
    return spark.read.schema(schema).json(f"{path}/data")


def summarise_export(back: DataFrame) -> DataFrame:
    """Per node: number of steps, first and last state, from the exported records."""
    steps = back.select("node_id", F.explode("data").alias("d")).select("node_id", "d.k", "d.state")
    return steps.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.min_by("state", "k").alias("first"), F.max_by("state", "k").alias("last"))
