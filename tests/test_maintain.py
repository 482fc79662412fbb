"""Insert / update / NOT IN semantics on small hand-made frames."""
from pyspark.sql import functions as F

from forumlens.operators import maintain
from forumlens.operators import select as S

SCHEMA = "comment_id long, article_id long, user_link string, comment_content string"


def test_first_write_wins_and_null_keys(spark):
    target = spark.createDataFrame([(1, 10, "u", "a"), (2, None, "u", "a")], SCHEMA)
    batch = spark.createDataFrame([(3, 10, "u", "a"),       # collides with target
                                   (5, 11, "u", "b"), (4, 11, "u", "b"),   # first in batch is id 4
                                   (6, None, "u", "a"), (7, None, "u", "a")],  # NULL keys never conflict
                                  SCHEMA)
    out = maintain.insert_first_wins(target, batch, ["article_id", "user_link", "comment_content"],
                                     ["comment_id"])
    assert sorted(r.comment_id for r in out.collect()) == [4, 6, 7]


def test_update_matched_only_present_attributes(spark):
    target = spark.createDataFrame([("l1", "t1", None), ("l2", "t2", "x")], "k string, title string, body string")
    batch = spark.createDataFrame([("l1", None, "new"), ("l3", "t3", "y")], "k string, title string, body string")
    found = maintain.update_matched(target, batch, "k", ["title", "body"], order="body")
    assert {r.k: (r.title, r.body) for r in found.collect()} == {"l1": ("t1", "new"), "l2": ("t2", "x")}


def test_update_matched_takes_one_row_of_a_repeated_key(spark):
    target = spark.createDataFrame([("l1", "t1"), (None, "t2")], "k string, title string")
    batch = spark.createDataFrame([("l1", "b", 2), ("l1", "a", 1), (None, "c", 0)], "k string, title string, n int")
    found = maintain.update_matched(target, batch, "k", ["title"], order="n")
    assert sorted(map(str, (r.title for r in found.collect()))) == ["a", "t2"]


def test_not_in_is_null_aware(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "user_link string")
    users = spark.createDataFrame([("a",)], "user_link string")
    assert [r.user_link for r in S.not_in(df, "user_link", users).collect()] == ["b"]
    with_null = spark.createDataFrame([("a",), (None,)], "user_link string")
    assert S.not_in(df, "user_link", with_null).count() == 0
    empty = spark.createDataFrame([], "user_link string")
    assert sorted(str(r.user_link) for r in S.not_in(df, "user_link", empty).collect()) == ["None", "a", "b"]
    df.createOrReplaceTempView("asked")
    for other in (users, with_null, empty):
        other.createOrReplaceTempView("others")
        plain = spark.sql("SELECT * FROM asked WHERE user_link NOT IN (SELECT user_link FROM others)")
        assert sorted(map(str, S.not_in(df, "user_link", other).collect())) == sorted(map(str, plain.collect()))


def test_empty_link_set_gives_empty_result(spark):
    articles = spark.createDataFrame([(1, "l1", None, None)],
                                     "article_id long, article_link string, article_content string, "
                                     "scraped_time timestamp_ntz")
    links = spark.createDataFrame([], "article_link string")
    assert S.unprocessed_in(articles, links).count() == 0


def test_record_runs_rejects_identical_settings(spark):
    import datetime as dt

    schema = "run_id long, state_dim int, k_max int, created timestamp_ntz"
    t = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame([(1, 3, 10, t)], schema)
    new = spark.createDataFrame([(None, 3, 10, t.replace(hour=1)),    # same settings: rejected
                                 (None, 3, 30, t.replace(hour=3)),
                                 (None, 2, 10, t.replace(hour=2)),
                                 (None, 2, 10, t.replace(hour=4))],   # repeats a new row: rejected
                                schema)
    out = maintain.record_runs(runs, new, ["state_dim", "k_max"])
    got = sorted((r.run_id, r.state_dim, r.k_max) for r in out.collect())
    assert got == [(1, 3, 10), (2, 2, 10), (3, 3, 30)]
    newest = maintain.latest_per_group(out.withColumn("g", F.lit(1)), "g", ["created"], ["run_id"]).first()
    assert newest.run_id == 3


def test_materialize(spark):
    from forumlens.session import materialize

    m = materialize(spark.range(10).withColumn("x", F.col("id") * 2))
    assert sorted(r.x for r in m.collect()) == list(range(0, 20, 2))


def test_checkpoint_folder_is_compulsory_on_a_cluster():
    import pytest

    from forumlens import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def test_null_keys_are_spread_and_match_nothing(spark):
    from forumlens.operators.training import left_join_keyed

    rows = spark.createDataFrame([(k, None if k % 3 else k % 7, f"t{k}") for k in range(300)], "id long, key long, text string")
    lookup = spark.createDataFrame([(k, f"v{k}") for k in range(4)] + [(None, "none")], "key long, value string")
    got = left_join_keyed(rows, lookup, "key")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(lookup, "key", "left").collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Union" not in plan
    named = left_join_keyed(rows.drop("id"), lookup, "key")  # no number to spread by
    assert named.count() == 300
