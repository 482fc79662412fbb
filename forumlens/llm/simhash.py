"""SimHash near-duplicates through pivot distance tables.

1. Every text gets a 64-bit fingerprint: a bit is set if it is set in over half of the
   hashes of the text's word shingles.
2. Distinct fingerprints are blocked so that no link is lost: the 64 bits fall into six
   blocks, four differing bits leave at least two blocks equal, so every linked pair
   meets under one of the fifteen pairs of blocks.
3. Within a block, a table of Hamming distances to ``PIVOTS`` reference fingerprints
   discards a pair if any coordinate differs by more than the allowed distance (the
   triangle inequality); survivors are verified on the fingerprints.
4. Components of the links are found by iterated star contraction in Spark.

A block never emits its pairs. Small blocks emit verified links; larger ones emit a
spanning star of every component inside them. Blocks of over ``TILE`` fingerprints are cut
into tiles, and every pair of tiles is a task of its own, so a group that holds a third
of all rows is spread, with bounded memory, and no candidate is dropped.

Cases: NULL, empty and blank texts have fingerprint 0 and link to each other; repeated
rows are all returned; a NULL key never names a component unless all its keys are NULL;
other columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F, types as T

from .common import prepared, text_bytes, written
from .components import connected_components

SEED = 42
SHINGLE_WORDS = 4
MAX_DISTANCE = 4
PIVOTS = 16
TILE = 4_096
PAIRWISE = 8
# Six blocks of 11, 11, 11, 11, 10 and 10 bits as (shift, width).
BLOCKS = ((53, 11), (42, 11), (31, 11), (20, 11), (10, 10), (0, 10))


def fingerprint(text: bytes, words_per_shingle: int = SHINGLE_WORDS) -> bytes:
    """Eight bytes, highest bit first. A-Z count as a-z; words are split at ASCII white space."""
    import numpy as np
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - words_per_shingle + 1)
    starts = np.concatenate([[0], ends[:n - 1] + 1]).tolist()
    stops = ends[min(words_per_shingle, len(words)) - 1:].tolist()
    hashes = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, stops)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int32) > n).tobytes()


def _fingerprints(words_per_shingle: int, kept: list[str]):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            prints = b"".join([fingerprint(t, words_per_shingle) for t in batch.column("__text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(np.frombuffer(prints, ">i8").astype(np.int64))],
                names=[*kept, "fp"])
    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 words_per_shingle: int = SHINGLE_WORDS, **extra) -> DataFrame:
    """key, fp long, and the ``extra`` column expressions: the fingerprint of every row's whole text."""
    rows = docs.select(F.col(key).alias("key"), *(c.alias(n) for n, c in extra.items()),
                       text_bytes(text).alias("__text"))
    kept = rows.columns[:-1]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(_fingerprints(words_per_shingle, kept), schema)


def pivot_table(prints):
    """Hamming distances of fingerprints to fixed reference fingerprints, one column each."""
    import numpy as np
    from xxhash import xxh64_intdigest

    pivots = np.array([xxh64_intdigest(str(k), SEED) for k in range(PIVOTS)], dtype=np.uint64)
    return np.bitwise_count(prints[:, None] ^ pivots).astype(np.int8)


def star_of(prints, distance: int) -> list[tuple[int, int]]:
    """(member, root) for every fingerprint that others of this block reach, by breadth-first search.

    Rows are sorted by their first pivot coordinate, so a row is compared only with the
    slice of rows whose coordinate is near enough.
    """
    import numpy as np

    table = pivot_table(prints)
    order = np.argsort(table[:, 0], kind="stable")
    prints, table = prints[order], table[order]
    left = np.arange(len(prints))
    out = []
    while len(left):
        root, frontier, left = left[0], [left[0]], left[1:]
        while frontier and len(left):
            node = frontier.pop()
            first = table[left, 0]
            low = np.searchsorted(first, table[node, 0] - distance)
            high = np.searchsorted(first, table[node, 0] + distance, side="right")
            near = left[low:high]
            near = near[(np.abs(table[near] - table[node]) <= distance).all(axis=1)]
            near = near[np.bitwise_count(prints[near] ^ prints[node]) <= distance]
            if len(near):
                out.extend((int(m), int(root)) for m in near)
                frontier.extend(near.tolist())
                left = left[~np.isin(left, near, assume_unique=True)]
    return [(int(prints[a]), int(prints[b])) for a, b in out]


def links_of_block_rows(groups, prints, distance: int):
    """Links inside the groups of a sorted run of rows (``groups``: a group number per row)."""
    import numpy as np

    bounds = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]]))
    sizes = np.diff(bounds)
    a, b = [], []
    for m in range(2, PAIRWISE + 1):
        starts = bounds[:-1][sizes == m]
        if len(starts):
            for i, j in combinations(range(m), 2):
                a.append(starts + i)
                b.append(starts + j)
    links = []
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        table = pivot_table(prints)
        near = (np.abs(table[a] - table[b]) <= distance).all(axis=1)
        a, b = a[near], b[near]
        near = np.bitwise_count(prints[a] ^ prints[b]) <= distance
        links = list(zip(prints[a[near]].tolist(), prints[b[near]].tolist()))
    for k in np.flatnonzero(sizes > PAIRWISE):
        links += star_of(prints[bounds[k]:bounds[k + 1]], distance)
    return links


def _links(distance: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(groups, prints):
            found = links_of_block_rows(groups, prints.view(np.uint64), distance)
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        kept_ids, kept = np.empty((0, 3), np.int64), np.empty(0, np.int64)
        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "ti", "tj")], axis=1)
            ids = np.concatenate([kept_ids, ids.astype(np.int64)])
            prints = np.concatenate([kept, batch.column("fp").to_numpy(zero_copy_only=False)])
            new = np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)])
            last = int(np.flatnonzero(new)[-1])  # its group may go on in the next batch
            if last:
                yield out(np.cumsum(new)[:last], prints[:last])
            kept_ids, kept = ids[last:], prints[last:]
        if len(kept):
            yield out(np.zeros(len(kept), np.int64), kept)
    return run


def block_rows(prints: DataFrame) -> DataFrame:
    """block, fp: each fingerprint under its fifteen pairs of equal-bit blocks."""
    piece = lambda shift, width: f"(shiftrightunsigned(fp, {shift}) & {(1 << width) - 1})"
    keys = [f"(shiftleft({k}L, 22) | shiftleft({piece(*x)}, {y[1]}) | {piece(*y)})"
            for k, (x, y) in enumerate(combinations(BLOCKS, 2))]
    return prints.selectExpr(f"explode(array({', '.join(keys)})) AS block", "fp")


def links(prints: DataFrame, distance: int = MAX_DISTANCE, tile: int = TILE) -> DataFrame:
    """a, b: links between distinct fingerprints that keep every component whole."""
    if not 0 <= distance <= len(BLOCKS) - 2:
        raise ValueError(f"distances up to {len(BLOCKS) - 2} bits are covered")
    rows = block_rows(prints)
    shared = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = f"CAST(ceil(n / {tile}D) AS INT)"
    own = f"CAST(pmod(xxhash64(fp), {tiles}) AS INT)"
    met = (rows.join(shared, "block")
           .selectExpr("block", "fp", f"{own} AS own", f"{tiles} AS tiles")
           .selectExpr("block", "fp", "own", "explode(sequence(0, tiles - 1)) AS other")
           .selectExpr("block", "least(own, other) AS ti", "greatest(own, other) AS tj", "fp"))
    return (met.repartition("block", "ti", "tj").sortWithinPartitions("block", "ti", "tj", "fp")
            .mapInArrow(_links(distance), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    words_per_shingle: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE,
                    tile: int = TILE, **extra) -> DataFrame:
    """key, the ``extra`` columns, fp long, class long, component_id.

    ``class`` is the smallest fingerprint a row's fingerprint reaches and ``component_id``
    the smallest key of its class.
    """
    prepared(docs.sparkSession)
    prints = written(fingerprints(docs, key, text, words_per_shingle, **extra), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("key").alias("first")), "fingerprint-classes")
    found = written(links(distinct.select("fp"), distance, tile), "fingerprint-links")
    labels = connected_components(found)
    linked = distinct.join(labels.withColumnRenamed("node", "fp"), "fp")
    lowest = linked.groupBy("component").agg(F.min("first").alias("lowest"))
    linked = linked.join(lowest, "component").select("fp", "component", "lowest")
    # Written, so that the last join alone stands above its shuffles and a very common
    # fingerprint's rows can be split.
    named = written(distinct.join(linked, "fp", "left")
                    .select("fp", F.coalesce("component", "fp").alias("class"),
                            F.coalesce("lowest", "first").alias("component_id")), "fingerprint-names")
    return prints.join(named, "fp").select(F.col("key").alias(key), *extra, "fp", "class", "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row of each class with all its columns: the least key, then the least hash of the text."""
    found = written(near_duplicates(docs, key, text, text_hash=F.xxhash64(text), **settings), "duplicate-classes")
    best = found.groupBy("class").agg(F.min(F.struct(F.col(key).alias("k"), F.col("text_hash").alias("h"))).alias("best"))
    best = best.select(F.col("best.k").alias("__k"), F.col("best.h").alias("__h"))
    chosen = found.join(best, found[key].eqNullSafe(best["__k"]) & (found["text_hash"] == best["__h"]), "left_semi")
    repeated = chosen.groupBy(key, "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = docs.withColumn("__row_hash", F.xxhash64(text))
    kept = rows.join(best, rows[key].eqNullSafe(best["__k"]) & (rows["__row_hash"] == best["__h"]), "left_semi")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    again = repeated.select(F.col(key).alias("__k"), F.col("text_hash").alias("__h"))
    same = kept[key].eqNullSafe(again["__k"]) & (kept["__row_hash"] == again["__h"])
    return (kept.join(again, same, "left_anti")
            .union(kept.join(again, same, "left_semi").dropDuplicates([key, "__row_hash"]))
            .select(*docs.columns))
