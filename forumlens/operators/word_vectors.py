"""Scoring texts against a label set given at call time, without labelled texts.

Word vectors come from the texts themselves: words are counted beside the ``contexts`` most frequent words
(within ``window`` tokens), counts become positive pointwise mutual information, and a randomised singular value
decomposition of that matrix, whose columns are the context words, gives ``dims`` directions: a random
start is multiplied by M'M a few times, each time one pass over the rows of M whose tasks add up
(contexts x dims) sums. A word's vector is its row of M in these directions.

A label is described by words; its vector is the mean of their unit vectors. A text's likeness to a
label is the mean cosine of its words, and its label vector the softmax of the likenesses.

The driver holds the context words, the (contexts x dims) directions and the label vectors, all of sizes
given by parameters. Words beside no context word, or unseen, have no vector and do not count; a text
without a vector has equal probabilities, a NULL text has none.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import softmax
from ..session import materialize
from . import word_chunks

CONTEXTS = 400
WINDOW = 2
DIMS = 32
TURNS = 4
SHARPNESS = 20.0


def frequent_words(texts: DataFrame, text: str, n: int) -> list[str]:
    """The ``n`` most frequent words, ties in code-point order."""
    counted = word_chunks.word_counts(texts, text)
    return [r["w"] for r in counted.orderBy(F.desc("n"), "w").limit(n).collect()]


def cooccurrences(texts: DataFrame, text: str, contexts: Sequence[str], window: int = WINDOW) -> DataFrame:
    """w, c (number of the context word), n: how often they stand within ``window`` tokens."""
    return word_chunks.beside_contexts(texts, text, contexts, window)


def information(counts: DataFrame) -> DataFrame:
    """w, cells array<struct<c, m>>: positive pointwise mutual information, one row per word that has any."""
    counts = materialize(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    by_context = counts.groupBy("c").agg(F.sum("n").alias("n_c"))
    by_word = counts.groupBy("w").agg(F.sum("n").alias("n_w"))
    value = F.log(F.col("n") * F.lit(float(total)) / (F.col("n_w") * F.col("n_c")))
    return materialize(counts.join(by_context, "c").join(by_word, "w").withColumn("m", value).where("m > 0")
                       .groupBy("w").agg(F.array_sort(F.collect_list(F.struct("c", "m"))).alias("cells")))


def _block(cells, width: int):
    """The rows of a batch as a dense matrix."""
    import numpy as np

    flat = cells.flatten()
    sizes = np.diff(cells.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), flat.field("c").to_numpy()] = flat.field("m").to_numpy()
    return out


def _gram_times(directions):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros_like(directions)
        for batch in batches:
            rows = _block(batch.column("cells"), len(directions))
            total += rows.T @ (rows @ directions)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                                         names=["c", "v"])
    return run


def gram_times(rows: DataFrame, directions):
    """M'M times the directions, summed over the tasks."""
    import numpy as np

    dims = directions.shape[1]
    parts = rows.select("cells").mapInArrow(_gram_times(directions), "c int, v array<double>")
    sums = parts.groupBy("c").agg(F.array(*[F.sum(F.col("v")[d]) for d in range(dims)]).alias("v"))
    out = np.zeros_like(directions)
    for r in sums.collect():  # one row per context word
        out[r["c"]] = r["v"]
    return out


def leading_directions(rows: DataFrame, contexts: int, dims: int = DIMS, turns: int = TURNS, seed: int = 1):
    """An orthonormal basis (contexts x dims) near the leading right singular vectors of M."""
    import numpy as np

    dims = min(dims, contexts)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(contexts, dims)))[0]
    for _ in range(turns):
        basis = np.linalg.qr(gram_times(rows, basis))[0]
    return basis


def _unit(vectors):
    import numpy as np

    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _cosines(directions, labels):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            likeness = _unit(_block(batch.column("cells"), len(directions)) @ directions) @ labels.T
            yield pa.RecordBatch.from_arrays([batch.column("w"), pa.array(likeness.tolist(), pa.list_(pa.float64()))], names=["w", "cos"])
    return run


def label_vectors(rows: DataFrame, directions, labels: Mapping[str, Sequence[str]]):
    """One unit vector per label, from its words' vectors; zero if none of them has any."""
    import numpy as np

    words = sorted({w.lower() for described in labels.values() for w in described})
    found = {}
    for r in rows.where(F.col("w").isin(words)).collect():  # words of the label set
        row = np.zeros(len(directions))
        row[[c["c"] for c in r["cells"]]] = [c["m"] for c in r["cells"]]
        found[r["w"]] = _unit(row[None] @ directions)[0]
    zero = np.zeros(directions.shape[1])
    return _unit(np.array([sum((found.get(w.lower(), zero) for w in described), zero) for described in labels.values()]))


def score_zero_shot(docs: DataFrame, key: str, text: str, labels: Mapping[str, Sequence[str]], corpus: DataFrame | None = None,
                    contexts: int = CONTEXTS, window: int = WINDOW, dims: int = DIMS, turns: int = TURNS,
                    sharpness: float = SHARPNESS, out: str = "vec") -> DataFrame:
    """key, out array<double>: probabilities over ``labels`` (name -> describing words), in their order.

    Word vectors are learned from ``corpus`` (column ``text``; default: ``docs``).
    """
    corpus = docs if corpus is None else corpus
    frequent = frequent_words(corpus, text, contexts)
    rows = information(cooccurrences(corpus, text, frequent, window))
    directions = leading_directions(rows, max(1, len(frequent)), dims, turns)
    likeness = rows.mapInArrow(_cosines(directions, label_vectors(rows, directions, labels)), "w string, cos array<double>")
    sums = word_chunks.word_sums(docs, key, text, likeness.select("w", F.col("cos").alias("v")), len(labels))
    mean = F.array(*[F.coalesce(sharpness * F.col(f"s{i}") / F.col("n"), F.lit(0.0)) for i in range(len(labels))])
    known = docs.where(F.col(text).isNotNull()).select(key).join(sums, key, "left").select(key, mean.alias("_l"))
    return docs.select(key).join(known.select(key, softmax("_l").alias(out)), key, "left")
