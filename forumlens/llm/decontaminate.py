"""Benchmark decontamination by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item is one
window); it is a sequence of shingles of ``SHINGLE`` words (or of all its words, if
fewer). A document contains a window only if it contains all of its shingles, so for
exact containment the necessary prefix is one shingle, and the rarest is the best:

1. every document is read once; its words are looked up in the benchmark's vocabulary
   and the places where a benchmark shingle stands are kept with their word numbers;
2. shingles are ordered by rarity, the number of their places in all documents;
3. the rarest shingle of each window joins the places; a length bound (the document has
   the window's words) and a positional bound (the window starts inside it) prune;
4. survivors are verified word by word.

Benchmarks go to the tasks in blocks of ``BLOCK_WORDS`` words, so what a task holds is
bounded however large the benchmark is; each block is a pass over the documents.

Cases: NULL and empty texts have no words; an item without words is never found;
repeated items and repeated documents count row by row, items by distinct id; a NULL
item_id is never listed; other columns are ignored; an empty benchmark hits nothing.
"""
from __future__ import annotations

from itertools import repeat

from pyspark.sql import DataFrame, functions as F, types as T

from .common import prepared, text_bytes, written

WINDOW = 10
SHINGLE = 5
BLOCK_WORDS = 200_000
MIX = 0x9E3779B97F4A7C15

# Bytes of a UTF-8 text: A-Z become a-z, digits, letters and all non-ASCII bytes stay,
# everything else separates words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def shingle_hashes(ids, places, size: int):
    """Hash of the ``size`` word numbers from each of the places on."""
    import numpy as np

    out = np.full(len(places), size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ ids[places + k].astype(np.uint64)) * np.uint64(MIX)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


class ItemBlock:
    """A block of benchmark texts: its vocabulary and the shingles of its windows."""

    def __init__(self, texts: list[bytes], window: int, shingle: int):
        import numpy as np

        self.window, self.shingle = window, shingle
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, list] = {}
        for text in texts:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)],
                           dtype=np.int32)
            if len(ids):
                size = self.size_for(len(ids))
                found.setdefault(size, []).append(shingle_hashes(ids, np.arange(len(ids) - size + 1), size))
        self.hashes = {size: np.unique(np.concatenate(parts)) for size, parts in found.items()}

    def size_for(self, words: int) -> int:
        return min(self.shingle, self.window, words)

    def ids_of(self, words: list[bytes]):
        import numpy as np

        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))


WINDOW_SCHEMA = "item_id string, ids array<int>, offset int, shingle long"


def _item_windows(block: ItemBlock):
    """A row for every shingle of every window of an item."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("__text").to_pylist()):
                ids = block.ids_of(words_of(text))
                if not len(ids):
                    continue
                size, length = block.size_for(len(ids)), min(block.window, len(ids))
                starts = np.arange(len(ids) - length + 1)
                offsets = np.arange(length - size + 1)
                hashes = shingle_hashes(ids, np.arange(len(ids) - size + 1), size)
                windows = [ids[a:a + length].tolist() for a in starts for _ in offsets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(windows), pa.string()), pa.array(windows, pa.list_(pa.int32())),
                     pa.array(np.tile(offsets, len(starts)), pa.int32()),
                     pa.array(hashes[(starts[:, None] + offsets).ravel()], pa.int64())],
                    names=["item_id", "ids", "offset", "shingle"])
    return run


PLACES = T.ArrayType(T.StructType([
    T.StructField("place", T.IntegerType()), T.StructField("shingle", T.LongType()),
    T.StructField("before", T.IntegerType()), T.StructField("around", T.ArrayType(T.IntegerType()))]))


def _find_places(block: ItemBlock, kept: list[str]):
    """Per document its number of words and every place of a benchmark shingle, with the words around."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        kind = pa.list_(pa.struct([("place", pa.int32()), ("shingle", pa.int64()),
                                   ("before", pa.int32()), ("around", pa.list_(pa.int32()))]))
        for batch in batches:
            docs = [words_of(t) for t in batch.column("__text").to_pylist()]
            sizes = np.array([len(d) for d in docs], dtype=np.int64)
            # One array for the batch; the 0 (no benchmark word) after each document ends every shingle.
            starts = np.concatenate([[0], np.cumsum(sizes + 1)])
            ids = np.zeros(starts[-1], dtype=np.int32)
            for words, at in zip(docs, starts.tolist()):
                ids[at:at + len(words)] = block.ids_of(words)
            unknown = np.concatenate([[0], np.cumsum(ids == 0)])
            found = [None] * len(docs)
            for size, table in block.hashes.items():
                full = np.flatnonzero(unknown[size:] == unknown[:-size])
                hashes = shingle_hashes(ids, full, size)
                known = table[np.minimum(np.searchsorted(table, hashes), len(table) - 1)] == hashes
                for at, tag in zip(full[known].tolist(), hashes[known].tolist()):
                    doc = int(np.searchsorted(starts, at, side="right")) - 1
                    low = max(int(starts[doc]), at + size - block.window)
                    high = min(int(starts[doc] + sizes[doc]), at + block.window)
                    found[doc] = found[doc] or []
                    found[doc].append({"place": at - int(starts[doc]), "shingle": tag, "before": at - low,
                                       "around": ids[low:high].tolist()})
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sizes, pa.int64()), pa.array(found, kind)],
                names=[*kept, "n_words", "places"])
    return run


def _blocks(items: DataFrame, block_words: int):
    """The benchmark in blocks of about ``block_words`` words (at least an item each)."""
    size = F.length("__text")
    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    count = max(1, -(-total // (4 * block_words)))  # over four bytes a word
    for k in range(count):
        yield items.where(F.pmod(F.xxhash64("__text"), F.lit(count)) == k)


def find_windows(rows: DataFrame, items: DataFrame, block: ItemBlock, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """(every row with its number of words, verified windows as __row, item_id, start, length)."""
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("n_words", T.LongType()),
                           T.StructField("places", PLACES)])
    seen = written(rows.mapInArrow(_find_places(block, kept), schema), "shingle-places")
    places = seen.where("places IS NOT NULL").select("__row", F.explode("places").alias("p")).select("__row", "p.*")
    rarity = places.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    shingles = written(items.mapInArrow(_item_windows(block), WINDOW_SCHEMA), "item-windows")
    # A window all of whose shingles occur is represented by the rarest of them.
    prefix = (shingles.select("ids", "offset", "shingle").distinct().join(rarity, "shingle", "left")
              .groupBy("ids").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("best"))
              .where("best.n > 0").select("ids", "best.shingle", "best.offset"))
    hits = (places.join(prefix, "shingle")
            .where("before >= offset AND before - offset + size(ids) <= size(around)")
            .where("slice(around, before - offset + 1, size(ids)) = ids")
            .select("__row", "ids", (F.col("place") - F.col("offset")).alias("start"), F.size("ids").alias("length")))
    owners = shingles.select("ids", "item_id").distinct()
    return seen.drop("places"), hits.distinct().join(owners, "ids").select("__row", "item_id", "start", "length")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  shingle: int = SHINGLE, block_words: int = BLOCK_WORDS, **extra) -> DataFrame:
    """key, the ``extra`` columns, n_words long, n_hit long (words inside found windows), spans
    array<struct<start, length>> (found windows, in words), items array<string> (sorted).
    """
    prepared(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), *(c.alias(n) for n, c in extra.items()),
                       F.monotonically_increasing_id().alias("__row"), text_bytes(text).alias("__text"))
    items = benchmark.select(F.col(item_key).cast("string").alias("item_id"), text_bytes(item_text).alias("__text"))
    blocks = list(_blocks(items, block_words))
    if len(blocks) > 1:
        rows = written(rows, "numbered-documents")  # the numbers must be the same in every pass
    sizes, found = None, []
    for part in blocks:
        texts = [bytes(r[0]) for r in part.select("__text").distinct().collect()]  # at most a block
        block = ItemBlock(texts, window, shingle)
        seen, hits = find_windows(rows, part, block, [c for c in rows.columns if c != "__text"])
        sizes = sizes or seen
        found.append(hits)
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    by_row = hits.groupBy("__row").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("items"))
    covered = F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.start + s.length - 1)))))")
    return (sizes.join(by_row, "__row", "left")
            .select(F.col("key").alias(key), *extra, "n_words",
                    F.when(F.col("spans").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_hit"),
                    F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))
