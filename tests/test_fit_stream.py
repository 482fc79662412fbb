"""Fits against plain gradient descent; the stream is idempotent."""
import numpy as np
import pytest

from pyspark.sql import functions as F

from forumlens.operators import fit


def _pairs(spark, sizes, seed=3):
    """Rows per user of a linear model with known weights."""
    rng = np.random.default_rng(seed)
    rows = []
    for user, n in sizes.items():
        P, Q, S = (rng.dirichlet(np.ones(3), n) for _ in range(3))
        W = rng.normal(0, 0.8, (3, 10))
        Y = np.tanh(np.hstack([P, Q, S, np.ones((n, 1))]) @ W.T)
        for k in range(n):
            rows.append((user, k, *(x[k].tolist() for x in (P, Q, S, Y)), float(rng.random()), float(rng.random()),
                         "train" if k % 5 else "val"))
    return spark.createDataFrame(rows, "user_id long, comment_id long, p array<double>, q array<double>, s array<double>, "
                                       "y array<double>, a double, b double, split string")


def _plain_fit(rows, kind, epochs, lr):
    """Full-batch gradient descent in NumPy."""
    P, Q, S, Y = (np.array([getattr(r, c) for r in rows]) for c in "pqsy")
    a, b = (np.array([[getattr(r, c)] for r in rows]) for c in "ab")
    if kind == "diff":
        P, Q = P - S, Q - S
    elif kind == "weighted":
        P, Q = P * a, Q * b
    X = np.hstack([P, Q, S, np.ones((len(rows), 1))])
    train = np.array([r.split == "train" for r in rows])
    W, losses = np.zeros((3, 10)), []
    for _ in range(epochs):
        E = np.tanh(X @ W.T)
        losses.append((float(((E - Y)[train] ** 2).mean()), float(((E - Y)[~train] ** 2).mean())))
        D = (E - Y)[train] * (1 - E[train] ** 2)
        W = W - lr * 2 / (3 * train.sum()) * D.T @ X[train]
    return W, losses


@pytest.mark.parametrize("kind", ["linear", "diff", "weighted"])
def test_fit_equals_plain_gradient_descent(spark, kind):
    pairs = _pairs(spark, {1: 40, 2: 7, 3: 300})
    rows = pairs.collect()
    got = {r.user_id: r for r in fit.fit_tanh(pairs.repartition(5), 4, kind=kind, lr=0.7).collect()}
    assert got.keys() == {1, 2, 3}
    for user, r in got.items():
        W, losses = _plain_fit([x for x in rows if x.user_id == user], kind, 4, 0.7)
        assert np.allclose([[r[f"t_{i}_{j}"] for j in range(10)] for i in range(3)], W)
        assert np.allclose(r.train_loss, [x for x, _ in losses]) and np.allclose(r.val_loss, [x for _, x in losses])


def test_fit_learns(spark):
    pairs = _pairs(spark, {1: 200})
    r = fit.fit_tanh(pairs, 25, lr=1.5).first()
    assert r.train_loss[-1] < 0.3 * r.train_loss[0] and r.val_loss[-1] < r.val_loss[0]


def test_settings_are_fitted_side_by_side(spark):
    pairs = _pairs(spark, {1: 30, 2: 20})
    grid = [{"setting": 5, "kind": "linear", "lr": 0.2}, {"setting": 6, "kind": "diff", "lr": 0.9}]
    got = {(r.user_id, r.setting): r.t_0_0 for r in fit.fit_tanh(pairs, 2, settings=grid).collect()}
    for g in grid:
        alone = fit.fit_tanh(pairs, 2, kind=g["kind"], lr=g["lr"]).collect()
        assert len(alone) == 2
        for r in alone:  # sums of doubles in another order
            assert got[r.user_id, g["setting"]] == pytest.approx(r.t_0_0, rel=1e-12, abs=1e-12)


def test_network_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    layers = (5, 4)
    x, y = rng.random((6, 9)), rng.dirichlet(np.ones(3), 6)
    train = np.array([True, True, False, True, True, False])
    w = fit.start_weights(layers)
    grad, on_train, on_val = fit.network_gradient(w, x, y, train, layers)
    for k in range(0, len(w), 7):
        up, down = w.copy(), w.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        slope = (fit.network_gradient(up, x, y, train, layers)[1] - fit.network_gradient(down, x, y, train, layers)[1]) / 2e-6
        assert grad[k] == pytest.approx(slope, abs=1e-6)


def test_network_fit_does_not_depend_on_packs(spark):
    pairs = _pairs(spark, {1: 60, 2: 9}).selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' AS normalized_posted_time")
    one, many = ({r.user_id: r for r in fit.fit_network(pairs, 3, (6, 4), 1.0, pack_rows=n).collect()} for n in (1000, 7))
    for user in (1, 2):
        assert np.allclose(one[user].weights, many[user].weights)
        assert np.allclose(one[user].train_loss, many[user].train_loss)
        assert one[user].train_loss[-1] < one[user].train_loss[0]
        assert len(one[user].weights) == 6 * 10 + 4 * 7 + 3 * 5


def test_wide_network_is_full_batch_descent(spark):
    """Layers of the full size, a user of many packs, against NumPy over all its rows."""
    pairs = _pairs(spark, {1: 90, 2: 11}).selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' AS normalized_posted_time")
    rows, layers = pairs.collect(), (128, 128)
    got = {r.user_id: r for r in fit.fit_network(pairs.repartition(6), 3, layers, 0.5, pack_rows=4).collect()}
    for user, r in got.items():
        own = [x for x in rows if x.user_id == user]
        x, y = np.array([[*x.p, *x.q, *x.s] for x in own]), np.array([x.y for x in own])
        train = np.array([x.split == "train" for x in own])
        w = fit.start_weights(layers)
        for _ in range(3):
            w = w - 0.5 / (3 * train.sum()) * fit.network_gradient(w, x, y, train, layers)[0]
        assert len(r.weights) == 128 * 10 + 128 * 129 + 3 * 129 and np.allclose(r.weights, w)


def test_a_task_sends_one_vector_per_key(spark):
    import pyarrow as pa

    pack = [{"p": [0.1] * 3, "q": [0.2] * 3, "s": [0.3] * 3, "y": [1.0, 0.0, 0.0], "is_train": True}]
    w = fit.start_weights((4,)).tolist()
    batch = pa.RecordBatch.from_pylist([{"key": k, "pack": pack, "weights": w} for k in (1, 1, 1, 2, 2)])
    from pyspark import TaskContext

    task = TaskContext._getOrCreate()
    task._partitionId = 0
    try:
        out = list(fit._task_gradients((4,), pa.int64())([batch, batch.slice(3)]))
    finally:
        TaskContext._setTaskContext(None)
    assert [b["key"][0].as_py() for b in out] == [1, 2]
    one = fit.network_gradient(np.array(w), np.array([[0.1] * 3 + [0.2] * 3 + [0.3] * 3]), np.array([[1.0, 0, 0]]), np.array([True]), (4,))[0]
    assert np.allclose(out[0]["grad"][0].as_py(), 3 * one) and np.allclose(out[1]["grad"][0].as_py(), 4 * one)


def test_run_artefacts_are_read_back(spark, tmp_path):
    fits = fit.fit_tanh(_pairs(spark, {1: 30, 2: 20}), 3)
    for run in ("a", "b"):
        fit.save_run(fits, str(tmp_path), run)
    weights, losses = fit.read_run(spark, str(tmp_path), "a")
    want = {r.user_id: r for r in fits.collect()}
    assert {r.user_id: r.t_2_9 for r in weights.collect()} == {u: r.t_2_9 for u, r in want.items()}
    assert {(r.user_id, r.epoch): r.train_loss for r in losses.collect()} == {
        (u, e): x for u, r in want.items() for e, x in enumerate(r.train_loss)}


def test_stream_rerun_adds_nothing(spark, tmp_path):
    from forumlens.streaming.ingest import read_sink, run_ingest

    import datetime as dt

    schema = ("comment_id long, article_id long, user_link string, comment_content string, agreements_text string, "
              "posted_text string, scraped_time timestamp_ntz")
    rest = ("1.2万", "3分前", dt.datetime(2024, 5, 1, 12, 30))
    rows = [(1, 1, "u", "a", *rest), (2, 1, "u", "a", *rest), (3, None, "u", "a", *rest), (4, 2, "v", "b", *rest),
            (5, 2, "w", "b", "x", *rest[1:]), (6, 2, "x", "b", rest[0], "2/30(月) 1:00", rest[2])]
    src, sink, ck = str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "ck")
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(src)
    run_ingest(spark, src, sink, ck, df.schema)
    rows = read_sink(spark, sink).collect()
    assert {(r.agreements_count, r.normalized_posted_time) for r in rows} == {(12000, dt.datetime(2024, 5, 1, 12, 27))}
    bad = spark.read.parquet(f"{sink}/quarantine").collect()
    assert {(r.comment_id, r.reason) for r in bad} == {(5, "bad_number"), (6, "bad_time")}
    once = sorted(r.comment_id for r in rows)
    run_ingest(spark, src, sink, ck, df.schema)
    twice = sorted(r.comment_id for r in read_sink(spark, sink).collect())
    assert once == twice == [1, 3, 4]


def test_a_retried_batch_adds_nothing_and_read_errors_stop(spark, tmp_path):
    from forumlens.streaming.ingest import Sink, create_sink, insert_batch, read_sink

    schema = ("comment_id long, article_id long, user_link string, comment_content string, agreements_text string, "
              "posted_text string, scraped_time timestamp_ntz")
    df = spark.createDataFrame([(k, k * 700, "u", "a", "1", None, None) for k in range(6)] + [(9, None, "u", "a", "1", None, None)], schema)
    sink = Sink(str(tmp_path / "sink"))
    with pytest.raises(Exception):
        insert_batch(spark, df, 0, sink)
    create_sink(spark, sink)
    for number in (0, 0, 1, 2):
        insert_batch(spark, df, number, sink)
    assert sorted(r.comment_id for r in read_sink(spark, sink.path).collect()) == [0, 1, 2, 3, 4, 5, 9]


def test_network_fits_agree_whether_local_or_not(spark):
    pairs = _pairs(spark, {1: 60, 2: 9, 3: 1}).selectExpr(
        "*", "timestamp_ntz'2024-01-01 00:00:00' AS normalized_posted_time").withColumn(
        "p", F.when(F.col("comment_id") == 5, F.array(F.lit(None).cast("double"), F.lit(0.5), F.lit(0.5))).otherwise(F.col("p")))
    fits = [{r.user_id: r for r in fit.fit_network(pairs, 3, (6, 4), 1.0, most=most).collect()} for most in (0, 20, 1000)]
    for got in fits[1:]:
        assert got.keys() == fits[0].keys() == {1, 2, 3}
        for user, r in got.items():
            want = fits[0][user]
            assert (r.n_train, r.n_val) == (want.n_train, want.n_val) and np.allclose(r.weights, want.weights)
            for c in ("train_loss", "val_loss"):
                assert [x is None for x in r[c]] == [x is None for x in want[c]]
                assert np.allclose([x or 0 for x in r[c]], [x or 0 for x in want[c]])


def test_a_network_s_weights_are_not_shuffled(spark):
    """Before, the plan joined every user's weights and gradients, once per epoch."""
    pairs = _pairs(spark, {1: 20, 2: 9}).selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' AS normalized_posted_time")
    plan = fit.fit_network(pairs, 3, (6, 4))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("FlatMapGroupsInArrow") == 1
