"""Target-distribution importance resampling.

1. Features are the runs of 1 to ``max_run`` consecutive words of a text, hashed to ``buckets``
   by crc32. Every task counts its texts into one array and emits it as (bucket, n) rows, which
   are summed; a bucket's gain is the scaled log ratio of its smoothed shares in the target
   and in the documents.
2. The gains are one array of ``buckets`` numbers, which goes to the tasks; a text's weight is
   the sum of its features' gains. Weight plus seeded Gumbel noise is the score, so that the
   highest scores are a draw without replacement in proportion to exp(weight / scale).
3. The draw is a distributed quickselect on the composite key (score descending, key ascending,
   hash of the text, row): random pivot keys of the rows still in question, exact counts of the
   rows before and at every pivot in one pass, and the interval that holds the k-th key is kept.
   A round divides the interval by about ``PIVOTS``; rows are unique in the key, so it ends
   at one row. Only the winners are sorted and ranked.

Cases: NULL, empty and wordless texts have no features and weight 0; rows with fewer than
``min_words`` words have a score and are never drawn; repeated rows are rows of their own; a NULL
key counts as an empty one for the noise and comes last among equal scores; other columns are
ignored; an empty target or an empty table is allowed.
"""
from __future__ import annotations

import zlib
from math import floor, log

from pyspark.sql import DataFrame, functions as F, types as T

from ..operators import sequence
from .common import prepared, text_bytes, written
from .decontaminate import words_of
from .token_files import Memo

BUCKETS = 10_000
MAX_RUN = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
SCALE = 1000
PIVOTS = 16


class Features:
    """Bucket numbers of the features of a text."""

    def __init__(self, buckets: int, max_run: int):
        self.buckets, self.max_run = buckets, max_run
        self.known = Memo(lambda word: zlib.crc32(word) % buckets)

    def of(self, words: list[bytes]) -> list[int]:
        found = list(map(self.known.__getitem__, words))
        if self.max_run > 1:
            sums = list(map(zlib.crc32, words))
            for run in range(1, self.max_run):
                # A run's checksum goes on from that of the run one word shorter.
                sums = [zlib.crc32(b" " + word, before) for before, word in zip(sums, words[run:])]
                found.extend(s % self.buckets for s in sums)
        return found


def _count(buckets: int, max_run: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        features, total = Features(buckets, max_run), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column("__text"):
                found = features.of(words_of(text.as_py()))
                if found:
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                                         names=["bucket", "n"])
    return run


def bucket_counts(rows: DataFrame, text: str = "text", buckets: int = BUCKETS, max_run: int = MAX_RUN) -> DataFrame:
    """bucket, n: features of all texts; at most ``buckets`` rows."""
    counted = rows.select(text_bytes(text).alias("__text")).mapInArrow(_count(buckets, max_run), "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text",
                 buckets: int = BUCKETS, max_run: int = MAX_RUN) -> list[int]:
    """The gain of every bucket."""
    source, wanted = ([0] * buckets for _ in range(2))
    for table, column, counts in ((docs, text, source), (target, target_text, wanted)):
        for row in bucket_counts(table, column, buckets, max_run).collect():  # at most ``buckets`` rows
            counts[row["bucket"]] = row["n"]
    in_source, in_target = sum(source) + buckets, sum(wanted) + buckets
    return [floor(SCALE * log((t + 1) * in_source / ((s + 1) * in_target))) for s, t in zip(source, wanted)]


def _weigh(gains: list[int], max_run: int, kept: list[str]):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        features, table = Features(len(gains), max_run), np.array(gains, dtype=np.int64)
        for batch in batches:
            sizes, weights = [], []
            for text in batch.column("__text"):
                words = words_of(text.as_py())
                found = features.of(words)
                sizes.append((len(words), len(found)))
                weights.append(int(table[found].sum()) if found else 0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([s[0] for s in sizes], pa.int64()),
                 pa.array([s[1] for s in sizes], pa.int64()), pa.array(weights, pa.int64())],
                names=[*kept, "n_words", "n_features", "weight"])
    return run


def importance_scores(docs: DataFrame, gains: list[int], key: str = "doc_id", text: str = "text",
                      max_run: int = MAX_RUN, seed: int = SEED) -> DataFrame:
    """key, __text_hash, n_words, n_features, weight, score (all long) of every row."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("__text_hash"), text_bytes(text).alias("__text"))
    kept = ["key", "__text_hash"]
    schema = T.StructType([*(rows.schema[c] for c in kept),
                           *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-float(SCALE)) * F.ln(-F.ln((drawn + F.lit(0.5)) / F.lit(4294967296.0))))
    return (rows.mapInArrow(_weigh(gains, max_run, kept), schema)
            .withColumn("score", F.col("weight") + noise.cast("long")))


ORDER = ("__less", "__null", "key", "__text_hash", "__row")


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS, order: tuple[str, ...] = ORDER, row: str = "__row"):
    """The values of ``order`` of the k-th row (from 1) in their ascending order, NULL first.

    ``rows`` must be a written table, unique in ``order``, with k rows at least.
    """
    place = F.struct(*order)

    def at(values):
        return F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, values)))
    inside, before, turn = rows, 0, 0
    low = high = None
    while True:
        drawn = inside.orderBy(F.xxhash64(F.lit(turn), row), row).limit(pivots).select(*order)
        found = [tuple(r) for r in drawn.orderBy(*order).collect()]  # ``pivots`` rows
        counts = inside.agg(*[F.count_if(place < at(p)) for p in found]).first()
        low_now, before_now = low, before
        for pivot, less in zip(found, counts):
            if before + less + 1 == k:
                return pivot
            if before + less + 1 > k:
                high = pivot
                break
            low_now, before_now = pivot, before + less + 1
        low, before, turn = low_now, before_now, turn + 1
        inside = rows
        if low is not None:
            inside = inside.where(place > at(low))
        if high is not None:
            inside = inside.where(place < at(high))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, max_run: int = MAX_RUN,
             seed: int = SEED, pivots: int = PIVOTS) -> DataFrame:
    """key, n_words, n_features, weight, score and rank (1, 2, ... in the order drawn; NULL: not drawn).

    ``percent`` of the rows with ``min_words`` words are drawn, rounded down.
    """
    prepared(docs.sparkSession)
    gains = bucket_gains(docs, target, text, target_text, buckets, max_run)
    scored = written(importance_scores(docs, gains, key, text, max_run, seed)
                     .withColumn("__row", F.monotonically_increasing_id()), "importance-scores")
    scored = scored.withColumn("__less", -F.col("score")).withColumn("__null", F.col("key").isNull())
    eligible = scored.where(F.col("n_words") >= min_words)
    k = eligible.count() * percent // 100
    out = [F.col("key").alias(key), "n_words", "n_features", "weight", "score"]
    if not k:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    last = kth_key(eligible, k, pivots)
    edge = F.struct(*(F.lit(v).cast(scored.schema[c].dataType).alias(c) for c, v in zip(ORDER, last)))
    drawn = (F.col("n_words") >= min_words) & (F.struct(*ORDER) <= edge)
    ranked = sequence.with_index(scored.where(drawn).withColumn("__all", F.lit(0)), "__all",
                                 [F.col(c).asc() for c in ORDER], "__place")
    return (scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank"))
            .unionByName(ranked.select(*out, (F.col("__place") + 1).alias("rank"))))
