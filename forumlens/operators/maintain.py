"""Table maintenance: first-write-wins inserts, matched updates, merges of sources.

Deduplication is an aggregation (``min_by`` over the key), so a key with a huge
number of copies is combined map-side instead of being sorted in one task.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _null_in(keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by ``order`` (ascending). Rows with a NULL in the
    key are all kept, since NULLs never conflict (K2)."""
    cols = [c for c in df.columns]
    keyed = df.where(~_null_in(keys))
    picked = (keyed.groupBy(*keys)
                   .agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
                   .select("_r.*"))
    return picked.unionByName(df.where(_null_in(keys)))


def insert_first_wins(target: DataFrame, batch: DataFrame, keys: list[str],
                      order: list[str]) -> DataFrame:
    """Rows of ``batch`` that do not collide with ``target`` or with an earlier
    batch row on ``keys`` (B01). Returns only the rows to add."""
    fresh = first_per_key(batch, keys, order)
    # NULL keys never match in an equi-join, so they survive the anti-join (K2)
    cond = [fresh[k] == target[k] for k in keys]
    return fresh.join(target.select(*keys), cond, "left_anti")


def apply_insert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The target table after a first-write-wins insert."""
    return target.unionByName(insert_first_wins(target, batch, keys, order))


def update_matched(target: DataFrame, batch: DataFrame, key: str, cols: list[str], order: str) -> DataFrame:
    """Overwrite ``cols`` of matched target rows with the batch values that are
    present (non-NULL); unmatched batch rows are ignored (B02, D12). Of batch rows with one
    key only the first by ``order`` counts, so a target row is never multiplied."""
    keyed = batch.select(key, F.col(order).alias("_order"), *cols).where(F.col(key).isNotNull())
    first = first_per_key(keyed, [key], ["_order"])
    renamed = first.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = target.join(renamed, key, "left")
    for c in cols:
        joined = joined.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c)))
    return joined.select(*target.columns)


def latest_per_group(df: DataFrame, group: str, order: list[str], cols: list[str]) -> DataFrame:
    """Newest row per group by ``order`` (B08 "fetch the newest run")."""
    return (df.groupBy(group)
              .agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
              .select(group, *[F.col("_r")[c].alias(c) for c in cols]))


def merge_sources(sources: list[tuple[str, DataFrame]], keys: list[str], order: list[str]) -> DataFrame:
    """Union several sources of the same rows into one deduplicated table (G01):
    sources earlier in the list win, then ``order``."""
    tagged = [df.withColumn("_prio", F.lit(i)).withColumn("origin", F.lit(name))
              for i, (name, df) in enumerate(sources)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return first_per_key(union, keys, ["_prio", *order]).drop("_prio")


def record_runs(runs: DataFrame, new: DataFrame, settings: list[str], order: str = "created",
                id_col: str = "run_id") -> DataFrame:
    """Run registry (B08): settings identical to a recorded run (or to an earlier new
    row) are rejected; accepted rows get ids after the largest recorded one, in
    ``order``. The registry holds one row per run, so numbering the few new rows
    in one ordered window is fine."""
    from pyspark.sql import Window

    fresh = insert_first_wins(runs, new, settings, [order])
    top = runs.select(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    added = (fresh.withColumn("_n", F.row_number().over(Window.orderBy(order, *settings)))
                  .withColumn(id_col, (top + F.col("_n")).cast("long"))
                  .drop("_n"))
    return runs.unionByName(added.select(*runs.columns))
