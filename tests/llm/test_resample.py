"""Importance resampling: the quickselect against sorting, features and cases against plain forms."""
import random
import zlib
from math import floor, log

from pyspark.sql import functions as F

from llm_tables import docs  # noqa: F401

from forumlens.llm.common import written
from forumlens.llm.decontaminate import words_of
from forumlens.llm.resample import Features, bucket_gains, kth_key, resample

TARGET = "item_id long, text string"


def runs(words, longest):
    return [b" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def test_features_are_checksums_of_runs():
    words = words_of("Ñandú the cat, THE cat. x9 the".encode())
    for longest in (1, 2, 3):
        assert sorted(Features(97, longest).of(words)) == sorted(zlib.crc32(r) % 97 for r in runs(words, longest))
    assert Features(97, 2).of([]) == []


def test_kth_key_is_that_of_a_sort(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.choice([None, 4, 5]), n) for n in range(300)]
    table = written(spark.createDataFrame(rows, "a long, b long, row long"), "kth").withColumn("none", F.col("b").isNull())
    order = ("a", "none", "b", "row")
    want = sorted((a, b is None, b or 0, n) for a, b, n in rows)
    for k, pivots in ((1, 3), (2, 16), (150, 1), (299, 4), (300, 16)):
        a, none, b, n = kth_key(table, k, pivots, order, "row")
        assert (a, none, b or 0, n) == want[k - 1]


def test_gains_scores_and_ranks(spark, docs):
    rng = random.Random(8)
    rows = [(n, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([5, 25, 40])))) for n in range(60)]
    rows += [(7, "a b c d e " * 5), (7, "a b c d e " * 5), (None, "g h " * 20), (None, "g h " * 20), (90, None), (91, ""), (92, "!?")]
    items = spark.createDataFrame([(1, "a b a b b"), (2, None), (3, "a")], TARGET)
    gains = bucket_gains(docs(rows), items, buckets=64, max_run=2)
    count = lambda texts: [f for t in texts for f in Features(64, 2).of(words_of((t or "").encode()))]
    s, t = count(r[1] for r in rows), count(["a b a b b", "", "a"])
    assert gains == [floor(1000 * log((t.count(b) + 1) * (len(s) + 64) / ((s.count(b) + 1) * (len(t) + 64))))
                     for b in range(64)]
    got = resample(docs(rows), items, buckets=64, max_run=2, percent=30).collect()
    assert len(got) == len(rows)
    eligible = [r for r in got if r.n_words >= 20]
    ranked = sorted((r for r in got if r.rank is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(eligible) * 30 // 100 + 1))
    order = lambda r: (-r.score, r.doc_id is None, r.doc_id or 0)
    assert [order(r) for r in ranked] == sorted(map(order, eligible))[:len(ranked)]
    for r in got:
        if r.doc_id in (90, 91, 92):
            assert (r.n_words, r.n_features, r.weight, r["rank"]) == (0, 0, 0, None)
    again = resample(docs(rows[::-1]), items, buckets=64, max_run=2, percent=30).collect()
    plain = lambda out: sorted(map(tuple, out), key=str)
    assert plain(again) == plain(got)


def test_empty_tables_and_other_columns(spark, docs):
    none = spark.createDataFrame([], TARGET)
    assert resample(docs([]), none).collect() == []
    table = docs([(1, "a " * 30), (2, "b " * 30)]).withColumnRenamed("n_chars", "score").withColumnRenamed("lang", "__row")
    got = resample(table, none, percent=50).collect()
    assert sorted(r["rank"] or 0 for r in got) == [0, 1]


def test_all_rows_equal(docs, spark):
    got = resample(docs([(1, "a " * 30)] * 50), spark.createDataFrame([(1, "a")], TARGET)).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5] and len({r.score for r in got}) == 1
