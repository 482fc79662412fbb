"""Per-user model fits as Spark aggregates.

Every epoch is one pass over the training rows: the rows meet their user's parameters, the
gradient of the squared error is summed per user (partial sums first, so a user with a large
share of the rows is combined where the rows are), and the parameters take a step of full-batch
gradient descent. Rows, shards and partitions only change the order of a sum of doubles, that is its
last bits. ``second_order`` fits the tanh kinds in far fewer passes. Parameters and losses of every epoch are written to the shared
checkpoint folder, which also cuts the lineage.

Kinds whose prediction is tanh(W x) run as column expressions, with x and the rows' targets
as plain columns:
  linear    x = [p | q | s | 1]
  diff      x = [p - s | q - s | s | 1]
  weighted  x = [a p | b q | s | 1], a and b the strengths of the parents
The ``network`` kind (ReLU layers, softmax output) sums gradients with NumPy. A key of at most
``local_fit.LOCAL_ROWS`` rows is fitted in the task that gets its rows, so its weights, which are larger than
its rows, are never moved. Of a larger key the gradients of bounded packs of rows are summed; a task adds up
its packs of a key, so a key sends one vector per task, and these are added in Spark.

The parameters start at a fixed rule, so a fit is the same on every run.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize
from . import local_fit, sequence

DIM = 3
INPUTS = 3 * DIM + 1
CELLS = [(i, j) for i in range(DIM) for j in range(INPUTS)]
CELL_NAMES = [f"t_{i}_{j}" for i, j in CELLS]


def input_columns(kind: str) -> list[Column]:
    p, q, s = ([F.col(c)[i] for i in range(DIM)] for c in "pqs")
    if kind == "diff":
        p, q = [x - z for x, z in zip(p, s)], [x - z for x, z in zip(q, s)]
    elif kind == "weighted":
        p, q = [x * F.col("a") for x in p], [x * F.col("b") for x in q]
    elif kind != "linear":
        raise ValueError(f"unknown kind {kind}")
    return [*p, *q, *s, F.lit(1.0)]


def training_rows(pairs: DataFrame, key: str, settings: Sequence[dict]) -> DataFrame:
    """One row per pair and setting: key, setting, lr, is_train, x0.., y0..; written once."""
    parts = None
    for s in settings:
        part = pairs.select(
            F.col(key).alias("key"), F.lit(int(s["setting"])).alias("setting"), F.lit(float(s["lr"])).alias("lr"),
            (F.col("split") == "train").alias("is_train"),
            *[x.alias(f"x{j}") for j, x in enumerate(input_columns(s["kind"]))],
            *[F.col("y")[i].alias(f"y{i}") for i in range(DIM)])
        parts = part if parts is None else parts.unionByName(part)
    return materialize(parts)


def _losses(state: DataFrame, add: bool) -> list[Column]:
    """Loss lists with this epoch's mean squared errors appended."""
    if not add:
        return [F.array().cast("array<double>").alias(c) for c in ("train_loss", "val_loss")]
    mean = lambda total, n: F.when(F.col(n) > 0, F.col(total) / (DIM * F.col(n)))
    return [F.concat("train_loss", F.array(mean("_train", "n_train"))).alias("train_loss"),
            F.concat("val_loss", F.array(mean("_val", "n_val"))).alias("val_loss")]


def fit_tanh(pairs: DataFrame, epochs: int, key: str = "user_id", kind: str = "linear", lr: float = 0.5,
             settings: Sequence[dict] | None = None) -> DataFrame:
    """Fit one model per key and setting. ``pairs``: key, p, q, s, y, split, and a, b for ``weighted``.

    Returns key, setting, n_train, n_val, the cells t_i_j of W (start: zero) and the losses
    before each epoch's step.
    """
    rows = training_rows(pairs, key, settings or [{"setting": 0, "kind": kind, "lr": lr}])
    state = rows.groupBy("key", "setting", "lr").agg(
        F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_val"))
    state = state.select("*", *[F.lit(0.0).alias(c) for c in CELL_NAMES], *_losses(state, False))
    for _ in range(epochs):
        state = materialize(_epoch(rows, state))
    return state.drop("lr").withColumnRenamed("key", key)


def _epoch(rows: DataFrame, state: DataFrame) -> DataFrame:
    met = rows.drop("lr").join(state.select("key", "setting", *CELL_NAMES), ["key", "setting"])
    out = [F.tanh(sum(F.col(f"t_{i}_{j}") * F.col(f"x{j}") for j in range(INPUTS))) for i in range(DIM)]
    met = met.select("key", "setting", "is_train", *[F.col(f"x{j}") for j in range(INPUTS)],
                     *[e.alias(f"e{i}") for i, e in enumerate(out)], *[F.col(f"y{i}") for i in range(DIM)])
    miss = [F.col(f"e{i}") - F.col(f"y{i}") for i in range(DIM)]
    slope = [F.when(F.col("is_train"), miss[i] * (1 - F.col(f"e{i}") * F.col(f"e{i}"))).otherwise(0.0).alias(f"d{i}")
             for i in range(DIM)]
    met = met.select("key", "setting", "is_train", *[F.col(f"x{j}") for j in range(INPUTS)], *slope,
                     sum(m * m for m in miss).alias("sq"))
    sums = met.groupBy("key", "setting").agg(
        *[F.sum(F.col(f"d{i}") * F.col(f"x{j}")).alias(f"g_{i}_{j}") for i, j in CELLS],
        F.sum(F.when(F.col("is_train"), F.col("sq"))).alias("_train"),
        F.sum(F.when(~F.col("is_train"), F.col("sq"))).alias("_val"))
    step = F.col("lr") * 2 / (DIM * F.greatest(F.col("n_train"), F.lit(1)))
    return state.join(sums, ["key", "setting"]).select(
        "key", "setting", "lr", "n_train", "n_val",
        *[(F.col(f"t_{i}_{j}") - step * F.col(f"g_{i}_{j}")).alias(f"t_{i}_{j}") for i, j in CELLS],
        *_losses(state, True))


def weight_arrays(fits: DataFrame) -> list[Column]:
    """W_p, W_q, W_s as matrices and the bias as an array."""
    block = lambda first: F.array(*[F.array(*[F.col(f"t_{i}_{first + j}") for j in range(DIM)]) for i in range(DIM)])
    return [block(0).alias("w_p"), block(DIM).alias("w_q"), block(2 * DIM).alias("w_s"),
            F.array(*[F.col(f"t_{i}_{INPUTS - 1}") for i in range(DIM)]).alias("b")]


# --- feed-forward network -------------------------------------------------------------

PACK_ROWS = 256  # rows whose gradient is summed at once
SALTS = 32


def layer_shapes(layers: Sequence[int], inputs: int = 3 * DIM, outputs: int = DIM) -> list[tuple[int, int]]:
    sizes = [inputs, *layers, outputs]
    return [(n, m + 1) for m, n in zip(sizes, sizes[1:])]  # the last column is the bias


def start_weights(layers: Sequence[int]):
    """Fixed start: golden-ratio points spread over (-1, 1), scaled by each layer's inputs."""
    import numpy as np

    parts, at = [], 0
    for n, m in layer_shapes(layers):
        points = ((np.arange(at, at + n * m) + 1) * 0.6180339887498949) % 1.0
        parts.append((2 * points - 1) / np.sqrt(m))
        at += n * m
    return np.concatenate(parts)


def network_gradient(weights, x, y, train, layers: Sequence[int]):
    """Sums over rows: gradient of the training rows' squared error, train and validation error."""
    import numpy as np

    mats, at = [], 0
    for n, m in layer_shapes(layers):
        mats.append(weights[at:at + n * m].reshape(n, m))
        at += n * m
    one = np.ones((len(x), 1))
    inputs = [np.hstack([x, one])]
    for w in mats[:-1]:
        inputs.append(np.hstack([np.maximum(inputs[-1] @ w.T, 0.0), one]))
    out = inputs[-1] @ mats[-1].T
    out = np.exp(out - out.max(axis=1, keepdims=True))
    out /= out.sum(axis=1, keepdims=True)
    miss = out - y
    sq = (miss ** 2).sum(axis=1)
    back = 2 * miss * train[:, None]
    back = out * (back - (back * out).sum(axis=1, keepdims=True))
    grads = []
    for w, inp in zip(mats[::-1], inputs[::-1]):
        grads.append((back.T @ inp).ravel())
        back = (back @ w)[:, :-1] * (inp[:, :-1] > 0)
    return np.concatenate(grads[::-1]), sq[train].sum(), sq[~train].sum()


def _task_gradients(layers: tuple[int, ...], kind):
    """One row per key and run of its packs in a task: the sums over all of them."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        names = ["key", "salt", "grad", "on_train", "on_val"]

        def row(key, grad, on_train, on_val):
            return pa.RecordBatch.from_arrays(
                [pa.array([key], kind), pa.array([salt], pa.int32()), pa.array([grad], pa.list_(pa.float64())),
                 pa.array([on_train], pa.float64()), pa.array([on_val], pa.float64())], names=names)
        current = None
        for batch in batches:
            keys, packs, weights = (batch.column(c) for c in ("key", "pack", "weights"))
            for n in range(batch.num_rows):
                pack = packs[n].as_py()
                x = np.array([[*r["p"], *r["q"], *r["s"]] for r in pack], dtype=float)
                y = np.array([list(r["y"]) for r in pack], dtype=float)
                train = np.array([r["is_train"] for r in pack], dtype=bool)
                known = ~(np.isnan(x).any(axis=1) | np.isnan(y).any(axis=1))  # others add nothing
                x, y, train = x[known], y[known], train[known]
                key = keys[n].as_py()
                new = network_gradient(weights[n].values.to_numpy(), x, y, train, layers)
                if current and current[0] == key:
                    current = (key, *(a + b for a, b in zip(current[1:], new)))
                else:
                    if current:
                        yield row(*current)
                    current = (key, *new)
        if current:
            yield row(*current)
    return run


def _added(names: list[str]):
    """The sum of the gradients and errors of a group, under its first keys."""
    def run(table):
        import numpy as np
        import pyarrow as pa

        grad = np.sum([np.asarray(g.values) for g in table["grad"]], axis=0)
        sums = [pa.array([sum(table[c].to_pylist())], pa.float64()) for c in ("on_train", "on_val")]
        return pa.table([*(table[c].slice(0, 1).combine_chunks() for c in names), pa.array([grad], pa.list_(pa.float64())), *sums],
                        [*names, "grad", "on_train", "on_val"])
    return run


def _fit_key(epochs: int, layers: tuple[int, ...], lr: float):
    """All epochs over the rows of one key."""
    def run(table):
        import numpy as np
        import pyarrow as pa

        columns, known = local_fit.numbers(table, local_fit.vector_columns(DIM))
        train, val = local_fit.sides(table)
        n_train, n_val = int(train.sum()), int(val.sum())
        known &= train | val
        x, y, on = columns[:3 * DIM, known].T, columns[3 * DIM:, known].T, train[known]
        weights, losses = start_weights(layers), ([], [])
        for _ in range(epochs):
            grad, *sums = network_gradient(weights, x, y, on, layers)
            weights = weights - lr / (DIM * max(n_train, 1)) * grad
            for kept, total, n in zip(losses, sums, (n_train, n_val)):
                kept.append(float(total) / (DIM * n) if n else None)
        doubles = pa.list_(pa.float64())
        return pa.table([table["key"].slice(0, 1), pa.array([n_train], pa.int64()), pa.array([n_val], pa.int64()),
                         pa.array([weights], doubles), *(pa.array([kept], doubles) for kept in losses)],
                        ["key", "n_train", "n_val", "weights", "train_loss", "val_loss"])
    return run


def fit_network(pairs: DataFrame, epochs: int, layers: Sequence[int] = (8,), lr: float = 0.5,
                key: str = "user_id", pack_rows: int = PACK_ROWS, most: int = local_fit.LOCAL_ROWS) -> DataFrame:
    """Fit a network per key. Returns key, n_train, n_val, weights array<double> (layer by layer,
    rows with their bias last), train_loss and val_loss before each epoch's step. Keys of more than ``most`` rows are
    fitted by sums over all tasks. The result is a plan: written by who needs it twice."""
    layers = tuple(int(n) for n in layers)
    order = ("normalized_posted_time", "comment_id")
    rows, _, large = local_fit.split_by_size(pairs, key, DIM, order, most)
    name = rows.schema["key"].dataType.simpleString()
    fits = rows.select("key", "is_train", *local_fit.vector_columns(DIM)).groupBy("key").applyInArrow(
        _fit_key(epochs, layers, float(lr)),
        f"key {name}, n_train long, n_val long, weights array<double>, train_loss array<double>, val_loss array<double>")
    fits = fits.withColumnRenamed("key", key)
    if large is not None:
        fits = fits.unionByName(_fit_network_by_passes(local_fit.vectors(large, key, DIM, order), epochs, layers, lr, key, pack_rows))
    return fits


def _fit_network_by_passes(pairs: DataFrame, epochs: int, layers: tuple[int, ...], lr: float, key: str, pack_rows: int) -> DataFrame:
    """``fit_network`` with every epoch as sums over all tasks."""
    order = [F.col("normalized_posted_time").asc(), F.col("comment_id").desc()]
    rows = sequence.with_index(pairs, key, order, "_place")
    packs = materialize(
        rows.groupBy(F.col(key).alias("key"), F.floor(F.col("_place") / pack_rows).alias("_pack"))
        .agg(F.collect_list(F.struct("p", "q", "s", "y", (F.col("split") == "train").alias("is_train"))).alias("pack"))
        .sortWithinPartitions("key"))
    state = pairs.groupBy(F.col(key).alias("key")).agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") != "train").alias("n_val"))
    start = pairs.sparkSession.createDataFrame([(1, start_weights(layers).tolist())], "_one int, weights array<double>")
    state = state.withColumn("_one", F.lit(1)).join(F.broadcast(start), "_one").drop("_one").select("*", *_losses(state, False))
    kind = state.schema["key"].dataType
    name, sums_schema = kind.simpleString(), "grad array<double>, on_train double, on_val double"
    step = F.lit(float(lr)) / (DIM * F.greatest(F.col("n_train"), F.lit(1)))
    for _ in range(epochs):
        met = packs.join(state.select("key", "weights"), "key").select("key", "pack", "weights")
        parts = met.mapInArrow(_task_gradients(layers, to_arrow_type(kind)), f"key {name}, salt int, {sums_schema}")
        # A key of very many tasks is added up in two steps, so that no task holds all its gradients.
        parts = parts.groupBy("key", "salt").applyInArrow(_added(["key", "salt"]), f"key {name}, salt int, {sums_schema}")
        sums = parts.groupBy("key").applyInArrow(_added(["key"]), f"key {name}, {sums_schema}")
        sums = sums.withColumnsRenamed({"on_train": "_train", "on_val": "_val"})
        state = materialize(state.join(sums, "key").select(
            "key", "n_train", "n_val",
            F.zip_with("weights", "grad", lambda w, g: w - step * g).alias("weights"), *_losses(state, True)))
    return state.withColumnRenamed("key", key)


# --- run artefacts --------------------------------------------------------------------

def save_run(fits: DataFrame, path: str, run_id: str, key: str = "user_id") -> None:
    """Run artefacts (B07): parameters per key and losses per (key, epoch), by run."""
    ids = [key, *(c for c in ("setting",) if c in fits.columns)]
    params = [c for c in fits.columns if c not in (*ids, "train_loss", "val_loss")]
    fits.select(*ids, *params).write.mode("overwrite").parquet(f"{path}/weights/run_id={run_id}")
    losses = F.posexplode(F.arrays_zip("train_loss", "val_loss")).alias("epoch", "l")
    (fits.select(*ids, losses).select(*ids, "epoch", "l.train_loss", "l.val_loss")
     .write.mode("overwrite").parquet(f"{path}/losses/run_id={run_id}"))


def read_run(spark, path: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(weights, losses) of a run."""
    return tuple(spark.read.parquet(f"{path}/{part}/run_id={run_id}") for part in ("weights", "losses"))
