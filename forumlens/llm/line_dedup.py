"""Line deduplication by pairwise alignment.

1. Runs: from every line that is not blank the shortest run of neighbouring lines of
   ``MIN_BLOCK_WORDS`` words or more that starts there, and the shortest that ends there. Every
   line of a common block lies in such a run within the block. The hash of a run is linked to
   the earliest document that has the run, whatever older documents have of its lines alone. A
   document is paired with the first holders of its runs only, over the lines of these runs, so
   a run in very many documents gives one pair per document and never all pairs; runs of one
   document alone, which are most, are dropped before anything is paired.
2. Each pair is aligned by patience diff over these lines: common ends first, then the
   lines that are unique in both stretches (the rare ones; where there are none, the n-th with
   the n-th place of a line) as anchors, kept in the longest order they agree on, then the
   stretches between anchors.
3. Runs of aligned lines that are neighbours in both documents are common blocks; blocks of
   ``MIN_BLOCK_WORDS`` words or more are deleted from the later document.

Cases: documents are ordered by key (NULL first), then by the hash of their text; rows of equal
key and text are one document, and all of them are returned; NULL texts stay NULL, empty
texts empty; blank lines are never matched, do not part a block, and stay; lines are compared
without their outer white space; other columns are returned unchanged; an empty table gives
an empty result.
"""
from __future__ import annotations

from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame, functions as F, types as T

from .common import prepared, written

MIN_BLOCK_WORDS = 5


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of (i, j), sorted by i, whose j rise (patience sorting)."""
    tops, piles, back = [], [], []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        tops[k:k + 1] = [j]
        piles[k:k + 1] = [n]
        back.append(piles[k - 1] if k else -1)
    out, n = [], piles[-1] if piles else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _nth_with_nth(a, a0, a1, b, b0, b1) -> list[tuple[int, int]]:
    """Pairs of the n-th places of equal lines, where no line is unique in both stretches."""
    seen, place = Counter(), {}
    for j in range(b0, b1):
        seen[b[j]] += 1
        place[b[j], seen[b[j]]] = j
    seen, out = Counter(), []
    for i in range(a0, a1):
        seen[a[i]] += 1
        if (a[i], seen[a[i]]) in place:
            out.append((i, place[a[i], seen[a[i]]]))
    return out


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: index pairs of equal lines, rising in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        seen_a, seen_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {h: j for j, h in enumerate(b[b0:b1], b0) if seen_b[h] == 1}
        unique = [(i, place[h]) for i, h in enumerate(a[a0:a1], a0) if seen_a[h] == 1 and h in place]
        anchors = _longest_rising(unique or _nth_with_nth(a, a0, a1, b, b0, b1))
        if anchors:
            i0, j0 = a0, b0
            for i, j in [*anchors, (a1, b1)]:
                todo.append((i0, i, j0, j))
                i0, j0 = i, j
    return sorted(out)


def common_blocks(pairs, first, later, words, least: int) -> list[int]:
    """Line numbers of the later document in blocks of ``least`` words or more.

    ``first`` and ``later``: the numbers of both documents' aligned lines.
    """
    out, block = [], []
    for n, (i, j) in enumerate(pairs):
        block.append(j)
        if n + 1 == len(pairs) or (first[pairs[n + 1][0]] - first[i], later[pairs[n + 1][1]] - later[j]) != (1, 1):
            if sum(words[k] for k in block) >= least:
                out += [later[k] for k in block]
            block = []
    return out


def _lines(runs) -> tuple[list[int], list[int], list[int]]:
    """Numbers, hashes and words of the lines of a document's runs, by number."""
    of = {run["line"] + n: x for run in runs for n, x in enumerate(zip(run["h"], run["words"]))}
    numbers = sorted(of)
    return numbers, [of[n][0] for n in numbers], [of[n][1] for n in numbers]


def _align_pairs(least: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for later, owned in zip(batch.column("later").to_pylist(), batch.column("owned").to_pylist()):
                numbers, hashes, words = _lines(later)
                first, of_first, _ = _lines(owned)
                found.append(common_blocks(align(of_first, hashes), first, numbers, words, least))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("hash"), pa.array(found, pa.list_(pa.int32()))],
                names=["key", "hash", "deleted"])
    return run


def _runs(least: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("lines")
            flat = lists.flatten()
            h = flat.field("h").to_numpy(zero_copy_only=False)
            words = flat.field("words").to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(len(sizes)), sizes)
            ends = np.cumsum(sizes)
            here, total = np.arange(len(h)), np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
            # Shortest runs from a line on, and up to a line.
            stop = np.maximum(np.searchsorted(total, total[:-1] + least), here + 1)
            start = np.minimum(np.searchsorted(total, total[1:] - least, side="right") - 1, here)
            on, up = stop <= ends[doc], start >= (ends - sizes)[doc]
            bounds = np.unique(np.stack([np.concatenate([here[on], start[up]]),
                                         np.concatenate([stop[on], here[up] + 1])], axis=1), axis=0)
            start, size = bounds[:, 0], bounds[:, 1] - bounds[:, 0]
            hashes, mixed = h.astype(np.uint64), np.zeros(len(start), np.uint64)
            for n in range(size.max(initial=0)):
                more = size > n
                mixed[more] = mixed[more] * np.uint64(0x9E3779B97F4A7C15) + hashes[start[more] + n]
            offsets = np.concatenate([[0], np.cumsum(size)])
            member = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
            held, offsets = pa.array(doc[start]), pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(held), batch.column("hash").take(held), pa.array(mixed.view(np.int64)),
                 pa.array(start - (ends - sizes)[doc[start]], pa.int32()),
                 pa.ListArray.from_arrays(offsets, pa.array(h[member], pa.int64())),
                 pa.ListArray.from_arrays(offsets, pa.array(words[member], pa.int32()))],
                names=["key", "hash", "run", "line", "h", "words"])
    return run


def _cut(kept: list[str], text: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, removed = [], []
            for body, deleted in zip(batch.column(text).to_pylist(), batch.column("__deleted").to_pylist()):
                if deleted:
                    gone, number, rest = set(deleted), -1, []
                    for line in body.split("\n"):
                        if line.strip(" \t\r"):
                            number += 1
                            if number in gone:
                                continue
                        rest.append(line)
                    body = "\n".join(rest)
                texts.append(body)
                removed.append(len(deleted or ()))
            kind = batch.schema.field(text).type
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, kind) if c == text else batch.column(c) for c in kept] + [pa.array(removed, pa.int32())],
                names=[*kept, "lines_deleted"])
    return run


def shared_runs(docs: DataFrame, key: str, text: str, least: int = MIN_BLOCK_WORDS) -> DataFrame:
    """key, hash, run, line, h, words, owner: the runs that several documents have."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    of_lines = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, "[ \t]+")).alias("words")))
    split = (docs.where(F.col(text).isNotNull())
             .select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), of_lines.alias("lines")))
    kind = split.schema["key"].dataType.simpleString()
    rows = written(split.mapInArrow(
        _runs(least), f"key {kind}, hash long, run long, line int, h array<long>, words array<int>"), "runs")
    doc = F.struct("key", "hash")
    # Written, so that the join alone stands above its shuffles and a very common run's rows
    # can be split.
    shared = written(rows.groupBy("run").agg(F.min(doc).alias("owner"), F.max(doc).alias("last"))
                     .where("owner <> last OR (owner.key IS NULL) <> (last.key IS NULL)").select("run", "owner"),
                     "shared-run-owners")
    return rows.join(shared, "run")


def delete_common_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text",
                         min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """All columns of ``docs``, ``text`` without the common blocks, and lines_deleted int."""
    prepared(docs.sparkSession)
    rows = written(shared_runs(docs, key, text, min_block_words), "shared-runs")
    runs = F.collect_set(F.struct("line", "h", "words"))  # a set: repeated rows are one document
    own = F.struct("key", "hash")
    owned = rows.where(own.eqNullSafe(F.col("owner"))).groupBy("owner").agg(runs.alias("owned"))
    later = rows.where(~own.eqNullSafe(F.col("owner"))).groupBy("key", "hash", "owner").agg(runs.alias("later"))
    pairs = (later.join(owned.withColumnRenamed("owner", "__owner"), F.col("owner").eqNullSafe(F.col("__owner")))
             .select("key", "hash", "later", "owned"))
    kind = rows.schema["key"].dataType.simpleString()
    cut = (pairs.mapInArrow(_align_pairs(min_block_words), f"key {kind}, hash long, deleted array<int>")
           .where(F.size("deleted") > 0).groupBy("key", "hash")
           .agg(F.array_distinct(F.flatten(F.collect_list("deleted"))).alias("__deleted"))
           .withColumnRenamed("key", "__key").withColumnRenamed("hash", "__of"))
    kept = [c for c in docs.columns if c not in ("lines_deleted", "__deleted", "__hash")]
    body = docs.select(*kept).withColumn("__hash", F.xxhash64(text))
    met = body.join(cut, body[key].eqNullSafe(cut["__key"]) & (body["__hash"] == cut["__of"]), "left")
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("lines_deleted", T.IntegerType())])
    return met.select(*kept, "__deleted").mapInArrow(_cut(kept, text), schema)
