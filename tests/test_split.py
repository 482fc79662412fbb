"""The split by selection against ordering all rows."""
import hashlib

import pytest

from forumlens.operators import training


def _plain(rows, tenths):
    users = {}
    for user, comment in rows:
        if user is not None:
            users.setdefault(user, []).append((hashlib.md5(str(comment).encode()).hexdigest(), comment))
    return {(u, c): "train" if r < len(hs) * tenths // 10 else "val"
            for u, hs in users.items() for r, (_, c) in enumerate(sorted(hs))}


@pytest.mark.parametrize("most,tenths", [(1_000_000, 8), (20, 8), (1, 3), (1, 0), (1, 9)])
def test_as_in_whole_order(spark, most, tenths):
    rows = [(1, k) for k in range(900)] + [(2, k) for k in range(900, 907)] + [(3, 1000), (None, 1001)]
    rows += [(4 + k % 50, 2000 + k) for k in range(300)]
    df = spark.createDataFrame(rows, "user_id long, comment_id long").selectExpr("*", "'x' AS _h", "1 AS split_rank")
    got = training.split_by_selection(df, tenths, most)
    assert got.columns == [*df.columns, "split"]
    assert {(r.user_id, r.comment_id): r.split for r in got.collect()} == _plain(rows, tenths)
    assert got.count() == len(rows) - 1


def test_ranked_split_is_the_same(spark):
    df = spark.range(500).selectExpr("id % 7 AS user_id", "id AS comment_id")
    one = training.train_val_split(df).select("user_id", "comment_id", "split")
    two = training.train_val_split(df, keep_rank=True).select("user_id", "comment_id", "split")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_no_rows(spark):
    assert training.train_val_split(spark.createDataFrame([], "user_id long, comment_id long")).count() == 0
