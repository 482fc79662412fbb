"""Fits of keys whose rows fit in a task: a key's rows move once and all passes run where they are.

The distributed fits move every row, and every key's parameters and sums, once per pass. For keys of
few rows the sums are larger than the rows, so that is left to the keys of more than ``LOCAL_ROWS`` rows, of
which there are few. The other keys are dealt out whole: a task gets all rows of a key, runs
all passes over them with NumPy and returns the fitted parameters.

A row whose inputs hold a NULL counts as a row but adds nothing to any sum; a NULL target adds nothing
to the sums that need it. Rows with a NULL key are left out.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

LOCAL_ROWS = 1 << 16    # rows of a key that a task takes whole
BUCKET_ROWS = 1 << 15   # rows that are fitted together, on average
VECTORS = ("p", "q", "s", "y")


def vector_columns(dim: int, more=()) -> list[str]:
    return [*(f"{c}{i}" for c in VECTORS for i in range(dim)), *more]


def split_by_size(pairs: DataFrame, key: str, dim: int, more=(), most: int = LOCAL_ROWS):
    """(rows of keys of at most ``most`` rows, their number, rows of the larger keys or None).

    The rows, written once: key, is_train, p0.. q0.. s0.. y0.. and ``more``."""
    rows = materialize(pairs.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), (F.col("split") == "train").alias("is_train"),
        *[F.get(c, F.lit(i)).cast("double").alias(f"{c}{i}") for c in VECTORS for i in range(dim)], *more))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    few = F.col("n") <= most
    n, n_large = counts.agg(F.coalesce(F.sum(F.when(few, F.col("n"))), F.lit(0)), F.count_if(~few)).first()
    if not n_large:
        return rows, n, None
    large = materialize(counts.where(~few).select("key"))
    return rows.join(large, "key", "left_anti"), n, rows.join(large, "key", "left_semi")


def vectors(rows: DataFrame, key: str, dim: int, more=()) -> DataFrame:
    """Rows of ``split_by_size`` in the form of the pairs that the distributed fits take."""
    return rows.select(F.col("key").alias(key), *[F.array(*[f"{c}{i}" for i in range(dim)]).alias(c) for c in VECTORS],
                       F.when(F.col("is_train"), "train").when(~F.col("is_train"), "val").alias("split"), *more)


def in_buckets(rows: DataFrame, n: int):
    """Rows grouped so that a key is in one group and a group has about ``BUCKET_ROWS`` rows."""
    return rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(n // BUCKET_ROWS + 1)).alias("bucket"))


def numbers(table, names):
    """Columns as an array (column, row) of doubles, NULLs as 0, and where a row has none of them."""
    import numpy as np

    out, known = np.zeros((len(names), table.num_rows)), np.ones(table.num_rows, dtype=bool)
    for k, name in enumerate(names):
        column = table[name].combine_chunks()
        out[k] = column.fill_null(0.0).to_numpy(zero_copy_only=False)
        if column.null_count:
            known &= column.is_valid().to_numpy(zero_copy_only=False)
    return out, known


def sides(table):
    """Which rows are training and which are validation rows."""
    train = table["is_train"].combine_chunks()
    return tuple(train.fill_null(x).to_numpy(zero_copy_only=False) == y for x, y in ((False, True), (True, False)))
