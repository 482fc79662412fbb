"""Second-order fits against NumPy and against many epochs of gradient descent."""
import numpy as np
import pytest

from forumlens.operators import second_order as so
from forumlens.operators.fit import CELLS
from test_fit_stream import _pairs, _plain_fit


def _inputs(rows, kind):
    P, Q, S, Y = (np.array([getattr(r, c) for r in rows]) for c in "pqsy")
    a, b = (np.array([[getattr(r, c)] for r in rows]) for c in "ab")
    if kind == "diff":
        P, Q = P - S, Q - S
    elif kind == "weighted":
        P, Q = P * a, Q * b
    return np.hstack([P, Q, S, np.ones((len(rows), 1))]), Y, np.array([r.split == "train" for r in rows])


def _plain_newton(rows, kind, passes, ridge):
    """Levenberg-Marquardt, one output at a time, with numpy.linalg."""
    X, Y, train = _inputs(rows, kind)
    W, losses = [], []
    for y in Y.T:
        w = c = np.zeros(10)
        best, damping, trace = None, so.DAMPING, []
        for _ in range(passes):
            e = np.tanh(X @ c)
            J = X[train] * (1 - e[train] ** 2)[:, None]
            n = max(train.sum(), 1)
            loss = ((e - y)[train] ** 2).sum() / n + ridge * c @ c
            if best is None or loss < best:
                best, w, damping = loss, c, damping / so.EASE
                H, g = J.T @ J / n, J.T @ (e - y)[train] / n + ridge * c
                seen = (((e - y)[train] ** 2).sum() / n, ((e - y)[~train] ** 2).mean() if (~train).any() else None)
            else:
                damping *= so.EASE
            trace.append(seen)
            c = w - np.linalg.solve(H + (ridge + damping) * np.eye(10), g)
        W.append(w)
        losses.append(trace)
    return np.array(W), np.array(losses, dtype=float).mean(axis=0)


@pytest.mark.parametrize("kind", ["linear", "diff", "weighted"])
def test_fit_equals_numpy(spark, kind):
    pairs = _pairs(spark, {1: 40, 2: 7, 3: 300})
    rows = pairs.collect()
    got = {r.user_id: r for r in so.fit_least_squares(pairs.repartition(5), 6, kind=kind).collect()}
    assert got.keys() == {1, 2, 3}
    for user, r in got.items():
        W, losses = _plain_newton([x for x in rows if x.user_id == user], kind, 6, so.RIDGE)
        assert np.allclose([[r[f"t_{i}_{j}"] for j in range(10)] for i in range(3)], W, rtol=1e-7, atol=1e-8)
        assert np.allclose(r.train_loss, losses[:, 0]) and np.allclose(r.val_loss, losses[:, 1])


def test_eight_passes_beat_two_hundred_epochs(spark):
    pairs = _pairs(spark, {1: 200, 2: 60})
    rows = pairs.collect()
    for r in so.fit_least_squares(pairs, 8).collect():
        _, losses = _plain_fit([x for x in rows if x.user_id == r.user_id], "linear", 200, 0.5)
        assert r.train_loss[-1] < losses[-1][0] and all(a > b - 1e-4 for a, b in zip(r.train_loss, r.train_loss[1:]))


def test_settings_and_users_without_training_rows(spark):
    pairs = _pairs(spark, {1: 30}).union(_pairs(spark, {2: 1}))  # the one row of user 2 is validation
    settings = [{"setting": 4, "kind": "linear", "ridge": 1e-2}, {"setting": 9, "kind": "diff"}]
    got = {(r.user_id, r.setting): r for r in so.fit_least_squares(pairs, 3, settings=settings).collect()}
    assert got.keys() == {(u, s) for u in (1, 2) for s in (4, 9)}
    alone = so.fit_least_squares(pairs, 3, ridge=1e-2).where("user_id = 1").first()
    assert got[1, 4].t_0_0 == pytest.approx(alone.t_0_0, abs=1e-10)
    empty = got[2, 4]
    assert (empty.n_train, empty.n_val) == (0, 1) and all(empty[f"t_{i}_{j}"] == 0 for i, j in CELLS)
    assert empty.train_loss == [None] * 3 and empty.val_loss[0] is not None


def test_damped_step_solves_the_system():
    rng = np.random.default_rng(0)
    full = np.array([a @ a.T for a in rng.normal(size=(5, 10, 10))])
    half = np.array([[m[j, k] for j, k in so.HALF] for m in full])
    g, add = rng.normal(size=(5, 10)), np.array([0.1, 1, 2, 0.5, 3.0])
    step = so.damped_step(half, g, add)
    for m, x, y, a in zip(full, step, g, add):
        assert np.allclose((m + a * np.eye(10)) @ x, y)


@pytest.mark.parametrize("kind", ["linear", "diff", "weighted"])
def test_local_and_distributed_fits_agree(spark, kind):
    """Keys of at most ``most`` rows in one task, the larger one by aggregations; NULLs add nothing to a sum."""
    pairs = _pairs(spark, {1: 40, 2: 7, 3: 90}).selectExpr(
        "user_id", "comment_id", "IF(comment_id = 3, array(NULL, 0.5D, 0.5D), p) AS p", "q", "s",
        "IF(comment_id = 4, array(0.1D, NULL, 0.2D), y) AS y", "a", "b", "split")
    pairs = pairs.unionByName(pairs.where("user_id = 1").selectExpr("CAST(NULL AS BIGINT) AS user_id", *pairs.columns[1:]))
    fits = [{r.user_id: r for r in so.fit_least_squares(pairs, 5, kind=kind, most=most).collect()} for most in (0, 50, 1000)]
    for got in fits[1:]:
        assert got.keys() == fits[0].keys() == {1, 2, 3}
        for user, r in got.items():
            want = fits[0][user]
            assert (r.n_train, r.n_val) == (want.n_train, want.n_val)
            assert np.allclose([r[f"t_{i}_{j}"] for i, j in CELLS], [want[f"t_{i}_{j}"] for i, j in CELLS], rtol=1e-7, atol=1e-8)
            assert np.allclose(r.train_loss, want.train_loss) and np.allclose(r.val_loss, want.val_loss)


def _jobs(spark, passes: int, pairs) -> int:
    spark.sparkContext.setJobGroup(f"fit-{passes}", "")
    so.fit_least_squares(pairs, passes).collect()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{passes}"))


def test_more_passes_move_no_more_rows(spark):
    """Every pass of a distributed fit has jobs of its own; a local one runs all passes in one."""
    pairs = _pairs(spark, {1: 20, 2: 9})
    assert _jobs(spark, 9, pairs) <= _jobs(spark, 2, pairs) + 1
