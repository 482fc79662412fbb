"""Stored listings against plain pages; what a deep page reads."""
from pyspark.sql import functions as F

from forumlens.operators import listing
from forumlens.operators import select as S
from forumlens.session import scratch_path
from test_key_index import _scanned


def _order():
    return [F.col("at").desc(), F.col("comment_id").desc()]


def test_pages_as_plain_pages(spark):
    path = scratch_path(spark, "listing")
    rows = spark.range(400).selectExpr("id AS comment_id", "CASE WHEN id % 9 = 0 THEN NULL WHEN id % 2 = 0 THEN 1 ELSE id % 30 END AS article_id",
                                       "CASE WHEN id % 4 > 0 THEN id % 5 END AS at")
    listing.store(rows, path, "article_id", _order())
    known = rows.where("article_id IS NOT NULL")
    for page in (1, 2, 7, 1000):
        want = S.listing_page(known, "article_id", _order(), page)
        got = listing.read_pages(spark, path, page).select(*want.columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert listing.read_pages(spark, path, 1, 100).count() == known.count()


def test_a_deep_page_reads_as_little_as_the_second(spark):
    path = scratch_path(spark, "listing")
    rows = spark.range(60_000).selectExpr("id AS comment_id", "CASE WHEN id % 3 > 0 THEN 1 ELSE id % 2000 END AS article_id", "id * 7 % 60013 AS at")
    listing.store(rows, path, "article_id", _order(), row_group_bytes=32 << 10)
    read = {}
    for page in (2, 1000):
        found = listing.read_pages(spark, path, page)
        assert all((page - 1) * 10 < r.position <= page * 10 for r in found.collect())
        read[page] = _scanned(found)
    assert 0 < read[1000] <= read[2] <= 15_000


def test_no_rows(spark):
    path = scratch_path(spark, "listing")
    listing.store(spark.createDataFrame([], "article_id long, comment_id long, at long"), path, "article_id", _order())
    assert listing.read_pages(spark, path, 1).count() == 0
