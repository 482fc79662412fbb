"""The stream of late parents against one batch join; what waits in the state store."""
import datetime as dt
import random

import pytest

from forumlens.session import scratch_path
from forumlens.streaming import late_parents as L



@pytest.fixture(autouse=True)
def _few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


DAY = dt.datetime(2024, 3, 1)


def _send(spark, source, rows, day):
    at = DAY + dt.timedelta(days=day)
    data = [(i, p, u, at - dt.timedelta(minutes=k % 50)) for k, (i, p, u) in enumerate(rows)]
    spark.createDataFrame(data, L.SCRAPED).write.mode("append").parquet(source)


def _threads(spark, sink):
    return dict(map(tuple, L.read_threads(spark, sink).collect()))


def _missing(spark, sink):
    return sorted(r.comment_id for r in L.read_missing(spark, sink).collect())


def _state(progress):
    return [op["numRowsTotal"] for p in progress for op in p["stateOperators"]]


def test_replies_come_before_their_parents(spark):
    source, sink = scratch_path(spark, "late-source"), scratch_path(spark, "late")
    rng = random.Random(3)
    rows = [(k, rng.choice([None, 7, rng.randrange(300), 900 + k % 5]), k % 11 != 0) for k in range(200)]
    rows += [(None, 3, True), (5, 7, True), (5, 7, True)]      # no id; the same reply again
    usable = {i for i, _, u in rows if u and i is not None}
    want = {}
    for i, p, _ in rows:
        if i is not None:
            found = [x for x in (want.get(i), p if p in usable else None) if x is not None]
            want[i] = min(found, default=None)
    for day, wave in enumerate(([r for r in rows if r[1] is not None], [r for r in rows if r[1] is None])):
        _send(spark, source, wave, day)
        L.run(spark, source, sink)
    assert _threads(spark, sink) == want
    assert _missing(spark, sink) == []       # they still wait
    L.run(spark, source, sink)               # nothing new
    assert _threads(spark, sink) == want


def test_the_wait_ends_and_the_state_is_freed(spark):
    source, sink = scratch_path(spark, "late-source"), scratch_path(spark, "late")
    waves = [(0, [(1, 100, True), (2, 200, True)]),      # both wait
             (2, [(100, None, True), (3, 300, True)]),   # 1 is linked, 3 waits
             (8, [(9, None, True)]), (9, [(10, None, True)]),   # 2 and 3 have waited for 5 days
             (10, [(200, None, True), (4, 200, True), (5, 2, True)])]
    sizes = []
    for day, wave in waves:
        _send(spark, source, wave, day)
        sizes.append(_state(L.run(spark, source, sink, wait="5 days", salts=2))[-1])
    assert _missing(spark, sink) == [2, 3]
    assert _threads(spark, sink) == {1: 100, 2: None, 3: None, 4: 200, 5: 2, 9: None, 10: None, 100: None, 200: None}
    # the rows of the newest arrival, twice for two salts, the replies and one tick an arrival of the last 5 days
    assert sizes == [4 + 2 + 1, 4 + 3 + 2, 2 + 1, 2 + 2, 6 + 3]


def test_a_retried_batch_changes_nothing(spark):
    sink = L.Threads(scratch_path(spark, "late"))
    L.create(spark, sink)
    first = spark.createDataFrame([(1, 2, True, DAY), (3, 1, True, DAY)], L.SCRAPED)
    second = spark.createDataFrame([(2, None, True, DAY)], L.SCRAPED)
    for number, batch in ((0, first), (0, first), (1, second), (1, second)):
        L.store_batch(spark, batch, number, sink)
    assert _threads(spark, sink.path) == {1: None, 2: None, 3: 1}
    waiting = spark.read.schema(L.REPLY).parquet(sink.folder("waiting")).where("comment_id IS NOT NULL")
    assert [tuple(r)[:2] for r in waiting.collect()] == [(1, 2)]


@pytest.mark.parametrize("salts", [1, 5])
def test_one_parent_of_most_replies(spark, salts):
    source, sink = scratch_path(spark, "late-source"), scratch_path(spark, "late")
    _send(spark, source, [(k, 5000 if k % 3 else 6000, True) for k in range(1000)], 0)
    L.run(spark, source, sink, salts=salts)
    _send(spark, source, [(5000, None, True)], 1)
    L.run(spark, source, sink, salts=salts)
    got = _threads(spark, sink)
    assert sum(p == 5000 for p in got.values()) == 666 and got[3] is None


def test_only_parents_that_replies_wait_for_enter_the_state(spark):
    """By default a stored row meets its waiting replies at their salts only; before, each went to all of them."""
    source, sink = scratch_path(spark, "late-source"), scratch_path(spark, "late")
    replies = [(k, 5000 if k % 3 else 6000 + k, True) for k in range(200)]
    _send(spark, source, replies, 0)
    first = L.run(spark, source, sink)
    assert _state(first)[-1] == 200 + 2     # the replies, a tick on either side
    _send(spark, source, [(5000, None, True), (6000, None, True), (6003, None, False)]
          + [(k, None, True) for k in range(7000, 7300)], 1)
    second = L.run(spark, source, sink)
    assert max(_state(second)) <= 200 + 4 + L.SALTS + 1
    got = _threads(spark, sink)
    assert sum(p == 5000 for p in got.values()) == 133 and got[0] == 6000 and got[3] is None
    late = spark.read.schema(L.REPLY).parquet(f"{sink}/late").where("comment_id IS NOT NULL")
    assert late.count() == 134 and late.select("comment_id").distinct().count() == 134


def test_the_wait_ends_when_no_stored_row_is_waited_for(spark):
    source, sink = scratch_path(spark, "late-source"), scratch_path(spark, "late")
    for day, wave in [(0, [(1, 100, True)]), (8, [(9, None, True)]), (9, [(10, None, True)]), (10, [(100, None, True)])]:
        _send(spark, source, wave, day)
        progress = L.run(spark, source, sink, wait="5 days")
    assert _missing(spark, sink) == [1] and _threads(spark, sink) == {1: None, 9: None, 10: None, 100: None}
    assert _state(progress)[-1] == 3 + 2     # a tick an arrival of the last 5 days, the last parent and its tick
