"""Ranged sequence operators equal plain per-key windows, including a hot key."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from forumlens.operators import sequence


def _data(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rnd.random() < 0.4 else rnd.randint(1, 30)   # key 0 is hot
        t = rnd.randint(0, 5000)                                  # ties on t are frequent
        val = None if rnd.random() < 0.7 else rnd.randint(0, 99)
        rows.append((key, t, i, val))
    return spark.createDataFrame(rows, "k long, t long, id long, val long")


def _order():
    return [F.col("t").asc(), F.col("id").desc()]


def test_index_matches_row_number(spark):
    df = _data(spark)
    got = sequence.with_index(df, "k", _order(), "idx")
    want = df.withColumn("idx", F.row_number().over(Window.partitionBy("k").orderBy(*_order())) - 1)
    assert sorted(map(tuple, got.select("id", "idx").collect())) == \
        sorted(map(tuple, want.select("id", "idx").collect()))


def test_neighbours_match_lag_and_lead(spark):
    df = _data(spark)
    w = Window.partitionBy("k").orderBy(*_order())
    for direction, fn in ((-1, F.lag), (1, F.lead)):
        got = sequence.with_neighbours(df, "k", _order(), ["id", "val"], direction, "n_")
        want = df.withColumn("n_id", fn("id").over(w)).withColumn("n_val", fn("val").over(w))
        cols = ["id", "n_id", "n_val"]
        assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_carry_forward_matches_last_ignore_nulls(spark):
    df = _data(spark)
    got = sequence.with_carry_forward(df, "k", _order(), "val", "c")
    w = Window.partitionBy("k").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("c", F.last("val", ignorenulls=True).over(w))
    assert sorted(map(tuple, got.select("id", "c").collect())) == sorted(map(tuple, want.select("id", "c").collect()))


def test_first_n_matches_rank_filter(spark):
    df = _data(spark)
    got = sequence.first_n_per_key(df, "k", _order(), 25, "rank")
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(*_order()))).where("rank <= 25")
    assert sorted(map(tuple, got.select("id", "rank").collect())) == \
        sorted(map(tuple, want.select("id", "rank").collect()))


def test_one_range_shuffle_serves_several_operators(spark):
    df = _data(spark)
    w = Window.partitionBy("k").orderBy(*_order())
    rows = sequence.ranged(df, "k", _order())
    got = sequence.with_index(rows, "k", _order(), "idx", total="n")
    got = sequence.plain(sequence.with_neighbours(got, "k", _order(), ["id"], 1, "n_"))
    want = (df.withColumn("idx", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("k")))
            .withColumn("n_id", F.lead("id").over(w)))
    cols = ["id", "idx", "n", "n_id"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert set(got.columns) == {"k", "t", "id", "val", "idx", "n", "n_id"}


def test_a_hot_key_is_split(spark):
    """One key with all rows, all at one time, still spans many ranges."""
    size = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).selectExpr("1 AS k", "0 AS t", "id", "if(id % 3 = 0, id, null) AS val")
        rows = sequence.ranged(df, "k", _order())
        sizes = [r["count"] for r in rows.groupBy(sequence.RANGE).count().collect()]
        assert len(sizes) >= 4 and max(sizes) < 2000
        got = sequence.with_carry_forward(rows, "k", _order(), "val", "c")
        got = sequence.with_neighbours(sequence.with_index(got, "k", _order(), "idx"), "k", _order(), ["id"], -1, "p_")
        out = sorted((r.idx, r.id, r.c, r.p_id) for r in got.collect())
        want = [(i, 3999 - i, min((x for x in range(3999 - i, 4000) if x % 3 == 0), default=None),
                 4000 - i if i else None) for i in range(4000)]
        assert out == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", size)
