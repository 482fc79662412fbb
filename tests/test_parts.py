"""Tables in parts against whole recounts and updates; files of parts that are not hit."""
import random
from pathlib import Path

from pyspark.sql import functions as F

from forumlens.operators import maintain, parts
from forumlens.session import scratch_path

SUMS = ["n", "agreed"]


def _files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def _batch(spark, seed, n=300):
    rng = random.Random(seed)
    return spark.createDataFrame([(rng.choice([None, 1, rng.randrange(40)]), 1, rng.choice([None, 2, 5])) for _ in range(n)],
                                 "article_id long, n long, agreed long")


def _sums(df):
    return sorted(map(tuple, df.groupBy("article_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS]).collect()), key=str)


def _kept(spark, path):
    return sorted(map(tuple, parts.read(spark, path).select("article_id", *SUMS).collect()), key=str)


def test_three_deltas_equal_one_count(spark):
    path = scratch_path(spark, "sums")
    parts.create_sums(spark, path, "article_id bigint", SUMS)
    every = None
    for number in range(3):
        batch = _batch(spark, number)
        every = batch if every is None else every.union(batch)
        parts.add_sums(batch, path, ["article_id"], SUMS, number, parts=6)
        parts.add_sums(batch, path, ["article_id"], SUMS, number, parts=6)   # a retry adds nothing
        assert _kept(spark, path) == _sums(every)
    before = _files(path)
    parts.add_sums(every.limit(0), path, ["article_id"], SUMS, 3, parts=6)
    assert _files(path) == before


def test_a_retry_after_half_a_commit_adds_what_is_missing(spark):
    path = scratch_path(spark, "sums")
    parts.create_sums(spark, path, "article_id bigint", SUMS)
    first, second = _batch(spark, 1), _batch(spark, 2)
    parts.add_sums(first, path, ["article_id"], SUMS, 0, parts=4)
    half = parts.part_of(["article_id"], 4) < 2
    parts.add_sums(second.where(half), path, ["article_id"], SUMS, 1, parts=4)
    parts.add_sums(second, path, ["article_id"], SUMS, 1, parts=4)
    assert _kept(spark, path) == _sums(first.union(second))


def test_only_hit_parts_are_written(spark):
    path = scratch_path(spark, "sums")
    parts.create_sums(spark, path, "article_id bigint", SUMS)
    parts.add_sums(spark.range(2000).selectExpr("id AS article_id", "1L AS n", "id AS agreed"), path, ["article_id"], SUMS, 0, 16)
    before = _files(path)
    parts.add_sums(spark.createDataFrame([(5, 1, 1), (5, 1, 1)], "article_id long, n long, agreed long"), path, ["article_id"], SUMS, 1, 16)
    changed = {name.split("/")[0] for name, _ in before.items() ^ _files(path).items()}
    assert len(changed) == 1
    assert parts.read(spark, path).where("article_id = 5").collect()[0][1:] == (3, 7)


def _articles(spark):
    return spark.createDataFrame([(k, f"link{k}", None if k % 3 else f"text{k}", "g") for k in range(60)]
                                 + [(90, None, "no link", "g"), (91, "link1", "same link", None)],
                                 "article_id long, link string, text string, genre string")


def test_update_as_over_the_whole_table(spark):
    path = scratch_path(spark, "articles")
    parts.write(_articles(spark), path, ["link"], 8)
    rows = [(k % 25, f"link{k % 25}", f"new{k}" if k % 2 else None, "h" if k % 5 == 0 else None) for k in range(40)]
    rows += [(1, None, "x", "x"), (1, "absent", "x", "x")] + [(0, "link7", "same", "s")] * 3
    batch = spark.createDataFrame(rows, "doc_id long, link string, text string, genre string").dropDuplicates(["doc_id", "link"])
    batch = batch.union(batch.where("link = 'link7'"))      # a row sent twice never doubles a stored one
    batch = spark.createDataFrame(batch.collect(), batch.schema)
    want = maintain.update_matched(_articles(spark), batch, "link", ["text", "genre"], "doc_id")
    parts.update(batch, path, scratch_path(spark, "batch"), "link", ["text", "genre"], "doc_id", 8)
    got = parts.read(spark, path).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_update_leaves_other_parts_alone(spark):
    path = scratch_path(spark, "articles")
    parts.write(_articles(spark), path, ["link"], 8)
    before = _files(path)
    schema = "doc_id long, link string, text string, genre string"
    for rows in ([], [(1, None, "x", "x"), (2, "absent", "x", "x")]):
        parts.update(spark.createDataFrame(rows, schema), path, scratch_path(spark, "batch"), "link", ["text", "genre"], "doc_id", 8)
        assert _files(path) == before
    parts.update(spark.createDataFrame([(1, "link4", "late", None)], schema), path, scratch_path(spark, "batch"),
                 "link", ["text", "genre"], "doc_id", 8)
    changed = {name.split("/")[0] for name, _ in before.items() ^ _files(path).items()}
    assert len(changed) == 1
    assert parts.read(spark, path).where("link = 'link4'").collect()[0]["text"] == "late"
