"""Inserts through the key index against plain first-write-wins inserts; what a lookup reads."""
import random

import pytest
from pyspark.sql import functions as F

from forumlens.operators import key_index as K
from forumlens.operators import maintain
from forumlens.session import scratch_path

SCHEMA = "comment_id long, article_id long, user_link string, comment_content string"
KEY = ["article_id", "user_link", "comment_content"]


def _rows(n, seed, first=0):
    rng = random.Random(seed)
    return [(first + k, rng.choice([None, 1, 2, 3]), rng.choice([None, "u", "v"]), rng.choice(["a", "b", None]) if k % 3 else f"t{k}")
            for k in range(n)]


def _plain(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("literal_keys", [0, 1000])
def test_three_batches_as_plain_inserts(spark, literal_keys):
    path = scratch_path(spark, "key-index")
    want = spark.createDataFrame([], SCHEMA)
    K.append_rows(want, path, KEY)
    for n in range(3):
        batch = spark.createDataFrame(_rows(150, n, 1000 * n) + _rows(20, 99, 9000 + 100 * n), SCHEMA)
        want = spark.createDataFrame(maintain.apply_insert(want, batch, KEY, ["comment_id"]).collect(), SCHEMA)
        K.insert(spark, path, batch, KEY, ["comment_id"], literal_keys)
        assert _plain(K.read_rows(spark, path)) == _plain(want)


def test_equal_hashes_of_different_keys_do_not_collide(spark, monkeypatch):
    monkeypatch.setattr(K, "key_hashes", lambda keys: [
        F.when(F.col(keys[0]).isNotNull(), F.lit(7).cast("long")).alias(c) for c in (K.HIGH, K.LOW)])
    path = scratch_path(spark, "key-index")
    K.append_rows(spark.createDataFrame([(1, 1, "u", "a")], SCHEMA), path, KEY)
    added = K.new_rows(spark, path, spark.createDataFrame([(2, 2, "u", "a")], SCHEMA), KEY, ["comment_id"])
    assert [r.comment_id for r in added.collect()] == [2]
    again = K.new_rows(spark, path, spark.createDataFrame([(3, 1, "u", "a")], SCHEMA), KEY, ["comment_id"])
    assert again.collect() == []


def _scanned(df):
    """Rows that the scans of a collected DataFrame gave out."""
    plan = df._jdf.queryExecution().executedPlan()
    leaves, todo, rows = [], [plan], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        name, children = node.nodeName(), node.children()
        if name.startswith(("ShuffleQueryStage", "BroadcastQueryStage")):
            todo.append(node.plan())
        todo += [children.apply(i) for i in range(children.size())]
        if name.startswith("Scan parquet"):
            leaves.append(name)
            rows += node.metrics().apply("numOutputRows").value()
    assert leaves
    return rows


def test_a_small_batch_reads_few_row_groups(spark):
    path = scratch_path(spark, "key-index")
    rows = spark.range(40_000).select(F.col("id").alias("comment_id"), (F.col("id") % 97).alias("article_id"),
                                      F.concat(F.lit("u"), "id").alias("user_link"), F.sha2(F.col("id").cast("string"), 256).alias("comment_content"))
    K.append_rows(rows, path, KEY, row_group_bytes=64 << 10)
    present, absent = rows.where("comment_id = 1234"), rows.where("comment_id = 1234").withColumn("user_link", F.lit("other"))
    for batch, hits in ((present, 1), (absent, 0)):
        asked = batch.select("*", *K.key_hashes(KEY))
        found = K.candidates(spark, path, asked, KEY)
        assert len(found.collect()) == hits
        assert _scanned(found) <= 4_000 if hits else _scanned(found) == 0  # the Bloom filters turn an absent key away
    whole = K.candidates(spark, path, rows.limit(50).select("*", *K.key_hashes(KEY)), KEY, literal_keys=10)
    whole.collect()
    assert _scanned(whole) == 40_000
