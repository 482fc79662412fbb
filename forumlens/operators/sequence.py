"""Per-key ordered sequences that stay balanced when one key is huge.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task. Here the rows
are first cut into ranges of (key, order) by one range shuffle, sorted and written
(``ranged``); a range is one task's share, so any key and any burst of one key is split,
whatever the data look like. Every row has the number of its range and a row number that
rises along the order, so a window runs over ``(key, range)`` and what crosses a border is
carried by small tables:

* ``with_index``: rows of the key in earlier ranges + position inside the range.
* ``with_neighbours``: previous / next row of the same key; at a border it is the last /
  first row of the adjacent range (one row per range).
* ``with_carry_forward``: last non-NULL value at or before each row.

Every operator takes plain rows, which it ranges itself, or rows that ``ranged`` returned
for the same keys and order, so several operators share one range shuffle. The rows
move twice at most: once to their range, once by (key, range). Rows with a NULL key are
left out.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

RANGE, ROW = "_range", "_row"


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def ranged(df: DataFrame, keys, order: Sequence[Column]) -> DataFrame:
    """``df`` written once in ranges of (keys, order), with ``RANGE`` and ``ROW``; ``order``
    must be a total order within a key."""
    keys = _keys(keys)
    by = [*map(F.col, keys), *order]
    return materialize(df.dropna(subset=keys).repartitionByRange(*by).sortWithinPartitions(*by)
                       .withColumn(RANGE, F.spark_partition_id())
                       .withColumn(ROW, F.monotonically_increasing_id()))


def plain(df: DataFrame) -> DataFrame:
    """Rows without the range columns."""
    return df.drop(RANGE, ROW)


def _prepared(df: DataFrame, keys: list[str], order: Sequence[Column]):
    if RANGE in df.columns:
        return df, lambda out: out
    return ranged(df, keys, order), plain


def with_index(df: DataFrame, keys, order: Sequence[Column], name: str = "idx",
               total: str | None = None) -> DataFrame:
    """Add the 0-based position of each row in its key's sequence (and, with ``total``, the
    number of rows of the key)."""
    keys = _keys(keys)
    rows, finish = _prepared(df, keys, order)
    inner = Window.partitionBy(*keys, RANGE).orderBy(ROW)
    counts = rows.groupBy(*keys, RANGE).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []
    offsets = counts.select(*keys, RANGE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), *extra)
    return finish(rows.withColumn("_pos", F.row_number().over(inner) - 1)
                  .join(offsets, [*keys, RANGE])
                  .withColumn(name, (F.col("_off") + F.col("_pos")).cast("bigint"))
                  .drop("_off", "_pos"))


def with_neighbours(df: DataFrame, keys, order: Sequence[Column], cols: Sequence[str],
                    direction: int = -1, prefix: str = "prev_") -> DataFrame:
    """Add ``prefix + col`` holding ``col`` of the previous (direction=-1) or next
    (direction=+1) row of the same key; NULL at the sequence end."""
    keys, cols = _keys(keys), list(cols)
    rows, finish = _prepared(df, keys, order)
    # One row per range: the last (looking back) or first (looking ahead) of the adjacent one. Written, so that
    # it is known to be small and the rows are joined with it where they are.
    carry = F.struct(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *cols)
    at, edge, shift = (F.min, F.max_by, F.lag) if direction < 0 else (F.max, F.min_by, F.lead)
    ends = materialize(rows.groupBy(RANGE).agg(at(ROW).alias("_at"), edge(carry, ROW).alias("_edge")))
    carried = ends.select(RANGE, "_at", shift("_edge").over(Window.orderBy(RANGE)).alias("_carry"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (F.col("_carry")[f"_k{i}"] == F.col(k))
    inner = Window.partitionBy(*keys, RANGE).orderBy(ROW)
    out = rows
    for col in cols:
        out = out.withColumn(prefix + col, shift(F.col(col), 1).over(inner))
    out = out.join(carried, RANGE, "left")
    crosses = (F.col(ROW) == F.col("_at")) & same
    for col in cols:
        out = out.withColumn(prefix + col, F.when(crosses, F.col("_carry")[col]).otherwise(F.col(prefix + col)))
    return finish(out.drop("_at", "_carry"))


def with_carry_forward(df: DataFrame, keys, order: Sequence[Column], col: str, name: str) -> DataFrame:
    """Add ``name`` = last non-NULL ``col`` at or before each row of the key."""
    keys = _keys(keys)
    rows, finish = _prepared(df, keys, order)
    running = (Window.partitionBy(*keys, RANGE).orderBy(ROW)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per_range = rows.groupBy(*keys, RANGE).agg(F.max_by(col, F.when(F.col(col).isNotNull(), F.col(ROW))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_range.select(*keys, RANGE, F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    return finish(rows.withColumn("_in", F.last(F.col(col), ignorenulls=True).over(running))
                  .join(carried, [*keys, RANGE])
                  .withColumn(name, F.coalesce("_in", "_carry"))
                  .drop("_in", "_carry"))


def first_n_per_key(df: DataFrame, keys, order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """Rows whose 1-based rank in their key's order is <= n (rank in ``name``).

    A rank filter on a window is planned as a partial group limit before the one shuffle: every
    task sends at most n rows of a key, so a hot key does not meet in one task.
    """
    place = F.row_number().over(Window.partitionBy(*_keys(keys)).orderBy(*order))
    return df.withColumn(name, place).where(F.col(name) <= n)
