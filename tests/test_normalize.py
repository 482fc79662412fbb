"""Golden cases for count and time texts, and small scalar helpers."""
import datetime as dt

from pyspark.sql import functions as F

from forumlens.functions import arrays as A
from forumlens.functions.normalize import normalize_count, normalize_time
from forumlens.sources.pages import archive_name


def _counts(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r.v for r in df.select(normalize_count("t").alias("v")).collect()]


def test_counts(spark):
    cases = {"1.3万": 13000, "2.5千": 2500, "1,234": 1234, "1,939件": 1939, "2392": 2392, "": 0,
             None: None, "1,234,567": 1234567, "0.57万": 5700, "abc": None, "１２３": 123,
             "1.5": None, "12人": 12, "3時間": 3}
    assert _counts(spark, list(cases)) == list(cases.values())


def test_times(spark):
    base = dt.datetime(2024, 8, 30, 19, 46, 30)
    cases = {
        "たった今": dt.datetime(2024, 8, 30, 19, 46),
        "15分前": dt.datetime(2024, 8, 30, 19, 31),
        "5時間前": dt.datetime(2024, 8, 30, 14, 46),
        "6日前": dt.datetime(2024, 8, 24, 19, 46),
        "8/23(金) 8:04": dt.datetime(2024, 8, 23, 8, 4),
        "10/10(木) 13:11": dt.datetime(2023, 10, 10, 13, 11),
        "2022/9/10(土) 13:01": dt.datetime(2022, 9, 10, 13, 1),
        "3週間前": None,
        "yesterday": None,
        "2/30(月) 1:00": None,
    }
    df = spark.createDataFrame([(t, base) for t in cases], "t string, b timestamp_ntz")
    got = [r.v for r in df.select(normalize_time("t", "b").alias("v")).collect()]
    assert got == list(cases.values())


def test_leap_day_without_year_rolls_back_to_invalid(spark):
    base = dt.datetime(2024, 2, 1, 0, 0)   # 2/29 later than base -> 2023-02-29 does not exist
    df = spark.createDataFrame([("2/29(木) 10:00", base)], "t string, b timestamp_ntz")
    assert df.select(normalize_time("t", "b").alias("v")).first().v is None


def test_vector_helpers(spark):
    df = spark.createDataFrame([([0.3, 0.6, 0.1], [0.6, 0.5, -0.5, -0.6])], "v array<double>, w array<double>")
    r = df.select((F.col("v")[0] - F.col("v")[2]).alias("s"), A.discretize("w").alias("d"),
                  A.one_hot_argmax("v").alias("o"), A.softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("p")).first()
    assert abs(r.s - 0.2) < 1e-12
    assert r.d == [1.0, 0.0, 0.0, -1.0]
    assert r.o == [0.0, 1.0, 0.0]
    assert r.p == [0.5, 0.5]


def test_archive_name(spark):
    df = spark.createDataFrame([('a\\b/c*d?e:f"g<h>i|j',), (None,)], "t string")
    assert [r.n for r in df.select(archive_name(F.col("t")).alias("n")).collect()] == \
        ["abcdefghij.html", "default_title.html"]


def test_model_slot_keeps_positions_and_nulls(spark):
    from forumlens.operators.vectors import score_with_model

    def predict(texts):
        return [None if t is None else {"positive": 0.5, "neutral": 0.3, "negative": len(t) / 10} for t in texts]

    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "abcd")], "id long, text string")
    got = {r.id: r.vec for r in score_with_model(df, "text", predict, ("negative", "positive", "neutral")).collect()}
    assert got == {1: [0.2, 0.5, 0.3], 2: None, 3: [0.4, 0.5, 0.3]}
