"""Words of texts counted and looked up by chunk, not by text.

The words of a chunk of texts become numbers into the chunk's own vocabulary, so a word is moved once per chunk
and not once per text that holds it, and what is done with tokens runs on arrays. A chunk is
at most ``CHUNK_BYTES`` of texts, or one longer text. Lower-casing is Spark's; the words are those of ``vectors.tokens``.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize

CHUNK_BYTES = 8 << 20
TOKEN_SPLIT = "[^0-9a-zà-ɏ]+"


def lower_texts(docs: DataFrame, text, *more: Column) -> DataFrame:
    """``more`` and ``_t``, the lower-cased text; NULL texts are left out."""
    return docs.select(*more, F.lower(F.col(text) if isinstance(text, str) else text).alias("_t")).where(F.col("_t").isNotNull())


def pieces(batches, text: str = "_t", row_bytes: int = 0, most: int | None = None):
    """Parts of Arrow batches with at most ``most`` (``CHUNK_BYTES``) of texts, batches of few texts put together.
    A row counts its text and ``row_bytes``."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size, most = [], 0, most or CHUNK_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.cumulative_sum(pc.add(pc.binary_length(batch.column(text)).cast(pa.int64()), row_bytes)).to_numpy()
        at = 0
        while at < batch.num_rows:
            used = int(ends[at - 1]) if at else 0
            stop = max(at + (not held), int(ends.searchsorted(used + most - size, side="right")))
            if stop > at:
                held.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1]) - used
                at = stop
            if at < batch.num_rows or size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def numbered(texts):
    """(vocabulary, number of every word in order, number of its text) of lower-cased texts."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    split = pc.split_pattern_regex(texts, TOKEN_SPLIT)
    words = split.flatten()
    inside = pc.not_equal(words, "")
    text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(split.offsets.to_numpy()))[inside.to_numpy(zero_copy_only=False)]
    coded = words.filter(inside).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), text


def _counts(batches):
    import numpy as np
    import pyarrow as pa

    for piece in pieces(batches):
        words, ids, _ = numbered(piece["_t"])
        yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.bincount(ids, minlength=len(words)), pa.int64())], names=["w", "n"])


def word_counts(texts: DataFrame, text) -> DataFrame:
    """w, n: how often each word occurs."""
    return lower_texts(texts, text).mapInArrow(_counts, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _beside(contexts: Sequence[str], window: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(contexts, pa.string())
        for piece in pieces(batches):
            words, ids, text = numbered(piece["_t"])
            words = words.cast(pa.string())
            context = pc.fill_null(pc.index_in(words, known), -1).to_numpy()[ids] if len(words) else np.empty(0, np.int32)
            found = [np.empty(0, np.int64)]
            for gap in range(1, window + 1):
                together = text[:-gap] == text[gap:]
                for one, other in ((slice(None, -gap), slice(gap, None)), (slice(gap, None), slice(None, -gap))):
                    at = together & (context[other] >= 0)
                    found.append(ids[one][at].astype(np.int64) * len(contexts) + context[other][at])
            cells, n = np.unique(np.concatenate(found), return_counts=True)
            w, c = np.divmod(cells, max(1, len(contexts)))
            yield pa.RecordBatch.from_arrays([words.take(pa.array(w)), pa.array(c, pa.int32()), pa.array(n, pa.int64())], names=["w", "c", "n"])
    return run


def beside_contexts(texts: DataFrame, text, contexts: Sequence[str], window: int) -> DataFrame:
    """w, c (number of the context word), n: how often they stand within ``window`` words of a text."""
    near = lower_texts(texts, text).mapInArrow(_beside(list(contexts), window), "w string, c int, n long")
    return near.groupBy("w", "c").agg(F.sum("n").alias("n"))


def _chunks(key_type):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for piece in pieces(batches):
            words, ids, text = numbered(piece["_t"])
            sizes = np.bincount(text, minlength=piece.num_rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([piece["_key"].to_pylist()], pa.list_(key_type)),
                 pa.array([sizes], pa.list_(pa.int32())), pa.array([ids], pa.list_(pa.int32())),
                 pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))],
                names=["chunk", "keys", "sizes", "ids", "words"])
            number += 1
    return run


def _sums(n: int):
    def run(chunk, found):
        import numpy as np
        import pyarrow as pa

        keys, sizes, ids = (chunk[c].combine_chunks().flatten() for c in ("keys", "sizes", "ids"))
        sizes, ids = sizes.to_numpy(), ids.to_numpy()
        text = np.repeat(np.arange(len(sizes)), sizes)
        values, known = np.zeros((n, int(ids.max(initial=-1)) + 1)), np.zeros(int(ids.max(initial=-1)) + 1, dtype=bool)
        if found.num_rows:  # else it has no columns
            places = found["pos"].to_numpy()
            values[:, places] = found["v"].combine_chunks().flatten().to_numpy().reshape(-1, n).T
            known[places] = True
        words = np.bincount(text, known[ids], len(sizes)).astype(np.int64)
        has = np.flatnonzero(words)
        sums = [pa.array(np.bincount(text, row[ids], len(sizes))[has].astype(float)) for row in values]
        return pa.table([keys.take(pa.array(has)), pa.array(words[has]), *sums], ["key", "n", *(f"s{i}" for i in range(n))])
    return run


def word_sums(docs: DataFrame, key: str, text: str, table: DataFrame, n: int) -> DataFrame:
    """key, n, s0..: of each text's words that ``table`` (w, v array<double> of ``n`` values) has, their number and the
    sums of their values. Rows of the same key are added up; texts without such words have no row."""
    kind = docs.schema[key].dataType
    chunks = materialize(lower_texts(docs, text, F.col(key).alias("_key")).mapInArrow(
        _chunks(to_arrow_type(kind)),
        f"chunk long, keys array<{kind.simpleString()}>, sizes array<int>, ids array<int>, words array<string>"))
    asked = chunks.select(F.col("chunk").alias("asker"), F.posexplode("words").alias("pos", "w"))
    found = asked.join(table.select("w", "v"), "w").select("asker", "pos", "v")
    schema = f"key {kind.simpleString()}, n long, " + ", ".join(f"s{i} double" for i in range(n))
    sums = (chunks.select("chunk", "keys", "sizes", "ids").groupBy("chunk").cogroup(found.groupBy("asker"))
            .applyInArrow(_sums(n), schema))
    return sums.groupBy("key").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]).withColumnRenamed("key", key)
