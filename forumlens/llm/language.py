"""Language identification by rank-order n-gram profiles.

A profile lists the ``profile_size`` most frequent letter n-grams (1 to 3 letters,
words padded by a blank) of a language in rank order; a document has the same kind of
profile, and its language is the one with the smallest out-of-place distance: the sum
over the document's n-grams of the difference of ranks, ``profile_size`` where the
language lacks the n-gram. N-grams that are equally frequent in a document share the
first of their ranks, so short documents do not depend on an arbitrary order.

The profiles are learned from a bounded sample: of each label, the
``docs_per_language`` training rows with the smallest hash of the key. Prediction reads
every text whole, and no column but the text.

Cases: NULL texts and texts without a letter are ``und`` with score 0; rows with a NULL
label or key do not train; with no training rows every prediction is ``und``; equal
distances go to the label first in code-point order; repeated rows are predicted alike
and all kept; other columns are ignored.
"""
from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import prepared, text_bytes, written

PROFILE_SIZE = 400
DOCS_PER_LANGUAGE = 2_000
MAX_LANGUAGES = 2_000
UNKNOWN = "und"
BLANK = 1  # stands for every character that is no letter


@lru_cache(maxsize=1)
def letter_table():
    import numpy as np

    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams_of(text: str):
    """Packed n-grams of a text (21 bits a letter) and their counts, in code order."""
    import numpy as np

    letters = letter_table()
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    codes = np.where(letters[codes], codes, BLANK)
    codes = np.concatenate([[BLANK], codes, [BLANK]])
    codes = codes[np.concatenate([[True], (codes[1:] != BLANK) | (codes[:-1] != BLANK)])]
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = (codes[:-1] << 21) | codes[1:]
    three = (codes[:-2] << 42) | two[1:]
    grams = np.concatenate([codes[codes != BLANK], two, three[codes[1:-1] != BLANK]])
    return np.unique(grams, return_counts=True)


def profile_of(text: str, size: int):
    """The document's most frequent n-grams and their ranks from 0, ties on one rank."""
    import numpy as np

    grams, counts = grams_of(text)
    order = np.argsort(-counts, kind="stable")[:size]
    counts = counts[order]
    place = np.arange(len(order))
    new = np.concatenate([[True], counts[1:] != counts[:-1]])[:len(order)]
    return grams[order], np.maximum.accumulate(np.where(new, place, 0))


def _count_grams(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        found: dict[str, list] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            found.setdefault(lang, []).append(text.decode("utf-8", "replace"))
        for lang, texts in found.items():
            grams, counts = grams_of("\n".join(texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(grams), lang, dtype=object), pa.string()),
                 pa.array(grams, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])


def training_sample(rows: DataFrame, key: str, label: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label at most: those whose hash of the key is small.

    The share to keep follows from the number of rows per label, so the filter runs in
    the scan; the hash makes the choice the same on every run.
    """
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    steps = 1 << 20
    share = {r[label]: min(steps, -(-per_label * steps // r["n"])) for r in sizes}
    if not share:
        return rows.limit(0)
    limits = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(steps)) < limits[F.col(label)])


def language_profiles(training: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang",
                      profile_size: int = PROFILE_SIZE,
                      docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """lang, gram, rank (from 0): the profile of every label. At most labels x profile_size rows."""
    rows = training.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col(label).cast("string").alias("lang"), text_bytes(text).alias("text"))
    counted = (training_sample(rows, "key", "lang", docs_per_language).select("lang", "text")
               .mapInArrow(_count_grams, "lang string, gram long, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (counted.withColumn("rank", F.row_number().over(best) - 1)
            .where(F.col("rank") < profile_size).select("lang", "gram", "rank"))


class Profiles:
    """All profiles as one table: n-gram -> rank in each language."""

    def __init__(self, rows, size: int):
        import numpy as np

        self.size = size
        self.langs = sorted({r[0] for r in rows})
        at = {lang: k for k, lang in enumerate(self.langs)}
        self.grams = np.array(sorted({r[1] for r in rows}), dtype=np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int64)
        if rows:
            place = np.searchsorted(self.grams, np.array([r[1] for r in rows], dtype=np.int64))
            self.ranks[place, [at[r[0]] for r in rows]] = [r[2] for r in rows]

    def predict(self, text: str) -> tuple[str, float]:
        import numpy as np

        grams, places = profile_of(text, self.size)
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, grams)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != grams] = len(self.grams)
        ranks = self.ranks[at]
        far = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - places[:, None]), self.size)).sum(axis=0)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (self.size * len(grams)))


def _predict(profiles: Profiles):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [profiles.predict(t.decode("utf-8", "replace")) for t in batch.column("__text").to_pylist()]
            kept = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], names=[*kept, "lang_pred", "score"])
    return run


def identify_languages(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text",
                       label: str = "lang", profile_size: int = PROFILE_SIZE,
                       docs_per_language: int = DOCS_PER_LANGUAGE,
                       keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns of every row of ``docs`` (the key alone if None), lang_pred, score.

    ``lang_pred`` and ``score`` replace kept columns of the same names.
    """
    prepared(docs.sparkSession)
    learned = language_profiles(training, key, text, label, profile_size, docs_per_language)
    rows = [tuple(r) for r in written(learned, "language-profiles").collect()]  # labels x profile_size at most
    kept = [c for c in (keep or (key,)) if c not in ("lang_pred", "score")]
    source = docs.select(*kept, text_bytes(text).alias("__text"))
    schema = T.StructType([*(source.schema[c] for c in kept),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(_predict(Profiles(rows, profile_size)), schema)


def held_out(key: str = "doc_id"):
    """Rows whose crc32 of the key as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
