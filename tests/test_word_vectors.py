"""Word vectors and zero-shot scores against NumPy, and accuracy on texts whose labels were never read."""
import re
from collections import Counter

import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

from forumlens.operators import word_vectors as W
from forumlens.plans.text import LANGUAGES
from forumlens.sources.tables import read_table

TEXTS = ["the cat sat on the mat", "the dog and the cat", "der hund und die katze", "die katze sitzt auf der matte", "",
         None, "und die der", "The mat, the DOG on the mat", "zzz", "katze und hund und die matte"]


def _split(text):
    return [w for w in re.split("[^0-9a-zà-ɏ]+", (text or "").lower()) if w]


def _plain(texts, n, window):
    """(words, PPMI matrix over the n most frequent words)."""
    count = Counter(w for t in texts for w in _split(t))
    contexts = sorted(count, key=lambda w: (-count[w], w))[:n]
    pairs = Counter()
    for t in texts:
        words = _split(t)
        for i, w in enumerate(words):
            for j in range(max(0, i - window), min(len(words), i + window + 1)):
                if j != i and words[j] in contexts:
                    pairs[w, contexts.index(words[j])] += 1
    words = sorted({w for w, _ in pairs})
    counts = np.zeros((len(words), n))
    for (w, c), k in pairs.items():
        counts[words.index(w), c] = k
    with np.errstate(divide="ignore"):
        value = np.log(counts * counts.sum() / np.outer(counts.sum(axis=1), counts.sum(axis=0)))
    return contexts, words, np.maximum(value, 0)


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k long, text string")


def test_information_and_directions_as_numpy(spark):
    contexts, words, plain = _plain(TEXTS, 6, 2)
    docs = _frame(spark, TEXTS).repartition(3)
    assert W.frequent_words(docs, "text", 6) == contexts
    rows = W.information(W.cooccurrences(docs, "text", contexts, 2))
    got = {r.w: {c.c: c.m for c in r.cells} for r in rows.collect()}
    want = {w: {c: m for c, m in enumerate(row) if m > 0} for w, row in zip(words, plain)}
    want = {w: cells for w, cells in want.items() if cells}
    assert got.keys() == want.keys()
    assert all(np.isclose(got[w][c], want[w][c]) for w in want for c in want[w]) and all(got[w].keys() == want[w].keys() for w in want)
    start = np.random.default_rng(0).normal(size=(6, 3))
    assert np.allclose(W.gram_times(rows, start), plain.T @ plain @ start)
    basis = W.leading_directions(rows, 6, 2, turns=60)
    right = np.linalg.svd(plain)[2][:2].T
    assert np.allclose(basis @ basis.T, right @ right.T, atol=1e-6)


def test_scores_as_numpy(spark):
    labels = {"english": ("the", "cat"), "german": ("Und", "katze"), "none": ("unseen",)}
    contexts, words, plain = _plain(TEXTS, 6, 2)
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    vectors = dict(zip(words, unit(plain)))  # all directions: cosines are those of the rows themselves
    kept = {w for w, row in zip(words, plain) if row.any()}
    means = unit(np.array([sum((vectors[w.lower()] for w in d if w.lower() in kept), np.zeros(6)) for d in labels.values()]))
    got = {r.k: r.vec for r in W.score_zero_shot(_frame(spark, TEXTS), "k", "text", labels, contexts=6, dims=6).collect()}
    assert got.keys() == set(range(len(TEXTS))) and got[5] is None
    for k, text in enumerate(TEXTS):
        if text is None:
            continue
        held = [w for w in _split(text) if w in kept]
        like = np.mean([means @ vectors[w] for w in held], axis=0) * W.SHARPNESS if held else np.zeros(3)
        e = np.exp(like - like.max())
        assert np.allclose(got[k], e / e.sum())


def test_accuracy_without_labels(spark):
    docs = read_table(spark, SMALL.replace("sf0.001", "sf0.01"), "documents").where("lang IS NOT NULL AND length(text) > 40")
    found = W.score_zero_shot(docs, "doc_id", "text", LANGUAGES).join(docs.select("doc_id", "lang"), "doc_id")
    best = F.element_at(F.array(*map(F.lit, LANGUAGES)), F.array_position("vec", F.array_max("vec")).cast("int"))
    right, total = found.select((best == F.col("lang")).cast("int").alias("ok")).agg(F.sum("ok"), F.count("ok")).first()
    assert total > 300 and right > 0.9 * total


def test_empty_corpus(spark):
    assert W.score_zero_shot(_frame(spark, TEXTS).limit(0), "k", "text", {"a": ("x",)}).collect() == []


def test_words_by_chunk_are_those_of_each_text(spark, monkeypatch):
    """Counts, neighbours and sums per chunk against plain Python over the tokens of Spark."""
    from collections import Counter

    from forumlens.operators import vectors, word_chunks

    rows = [(1, "The cat, the CAT ran. İstanbul Straße ÉTÉ"), (2, ""), (3, None), (4, "..."), (5, "cat 12 " * 40),
            (5, "ran cat"), (None, "the cat"), (6, "ωΣ ran Kelvin")]
    docs = spark.createDataFrame(rows, "k long, t string")
    tokens = [(r.k, r.w) for r in docs.select("k", vectors.tokens("t").alias("w")).collect() if r.w is not None]
    want = Counter(w for _, ws in tokens for w in ws)
    assert {r.w: r.n for r in word_chunks.word_counts(docs, "t").collect()} == want
    near = Counter()
    for _, ws in tokens:
        for i, w in enumerate(ws):
            for j in range(max(0, i - 2), min(len(ws), i + 3)):
                if j != i and ws[j] in ("cat", "ran"):
                    near[w, ("cat", "ran").index(ws[j])] += 1
    got = word_chunks.beside_contexts(docs, "t", ["cat", "ran"], 2).collect()
    assert {(r.w, r.c): r.n for r in got} == near
    table = spark.createDataFrame([("cat", [1.0, 0.5]), ("ran", [2.0, -1.0]), ("none", [9.0, 9.0])], "w string, v array<double>")
    sums = {r.k: (r.n, r.s0, r.s1) for r in word_chunks.word_sums(docs, "k", "t", table, 2).collect()}
    assert sums == {1: (3, 4.0, 0.0), 5: (42, 43.0, 19.5), None: (1, 1.0, 0.5), 6: (1, 2.0, -1.0)}


def test_pieces_hold_every_row_once(monkeypatch):
    import pyarrow as pa

    from forumlens.operators import word_chunks

    monkeypatch.setattr(word_chunks, "CHUNK_BYTES", 10)
    texts = ["a" * n for n in (3, 0, 4, 25, 10, 1, 9, 9, 2, 0)]
    batches = [pa.RecordBatch.from_pylist([{"_t": t} for t in part]) for part in (texts[:4], texts[4:5], texts[5:])]
    got = [p["_t"].to_pylist() for p in word_chunks.pieces(batches)]
    assert [t for p in got for t in p] == texts
    assert all(len(p) == 1 or sum(map(len, p)) <= 10 for p in got) and len(got) < len(texts)
