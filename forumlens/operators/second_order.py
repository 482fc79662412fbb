"""Second-order fits of the tanh models: Levenberg-Marquardt with one aggregation per pass.

The outputs of ``tanh(W x)`` have weights of their own, so each (key, setting, output) is a least-squares
problem in the ``INPUTS`` weights of its row of W. A pass is one aggregation over the training rows at the
candidate weights c: with e = tanh(c x) and d = 1 - e * e it sums the normal matrix d d x x', the
residual vector (e - y) d x and the squared errors, partial sums first, so that a key with a large share of
the rows is combined where the rows are. Then, per problem:

* the candidate is taken if its loss, mean squared error + ridge * |c|^2, is below that of
  the best weights so far, and the damping is divided by ``EASE``; else the best weights, with their matrix,
  stay and the damping is multiplied by it;
* the next candidate is the best weights less the solution of (matrix + (ridge + damping) I) step = gradient,
  by Cholesky.

The ridge makes the minimum unique: the inputs are collinear, as label vectors sum to one. Problems without
training rows keep the start, zero. Sums of doubles depend on the order of rows in the last bits, so two runs
agree to about 1e-10.

Keys of at most ``local_fit.LOCAL_ROWS`` rows run all passes in the task that gets their rows (``_fit_bucket``).
For larger keys each pass is such an aggregation in Spark, written to the shared checkpoint folder.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize
from . import local_fit
from .fit import CELLS, DIM, INPUTS, input_columns

PASSES = 8
RIDGE = 1e-4
DAMPING = 0.04
EASE = 4.0
HALF = [(j, k) for j in range(INPUTS) for k in range(j + 1)]  # cells of a symmetric matrix


def training_rows(pairs: DataFrame, key: str, settings: Sequence[dict]) -> DataFrame:
    """One row per pair and setting: key, setting, ridge, is_train, x0.., y0..; written once."""
    parts = None
    for s in settings:
        part = pairs.select(
            F.col(key).alias("key"), F.lit(int(s["setting"])).alias("setting"),
            F.lit(float(s.get("ridge", RIDGE))).alias("ridge"), (F.col("split") == "train").alias("is_train"),
            *[x.cast("double").alias(f"x{j}") for j, x in enumerate(input_columns(s["kind"]))],
            F.col("y").alias("y"))
        parts = part if parts is None else parts.unionByName(part)
    return materialize(parts)


def _pass(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The sums of every problem at its candidate weights."""
    asked = state.groupBy("key", "setting").agg(F.collect_list(F.struct("output", "candidate")).alias("asked"))
    met = rows.join(asked, ["key", "setting"]).select("*", F.explode("asked").alias("a")).select(
        "key", "setting", "is_train", *[f"x{j}" for j in range(INPUTS)], F.col("a.output").alias("output"),
        F.get("y", F.col("a.output")).alias("y"),
        F.tanh(sum(F.col("a.candidate")[j] * F.col(f"x{j}") for j in range(INPUTS))).alias("e"))
    met = met.withColumn("miss", F.col("e") - F.col("y")).withColumn(
        "slope", F.when(F.col("is_train"), 1 - F.col("e") * F.col("e")).otherwise(0.0))
    met = met.select("key", "setting", "output", "is_train", (F.col("miss") * F.col("miss")).alias("square"), "miss",
                     *[(F.col("slope") * F.col(f"x{j}")).alias(f"v{j}") for j in range(INPUTS)])
    return met.groupBy("key", "setting", "output").agg(
        *[F.sum(F.col(f"v{j}") * F.col(f"v{k}")).alias(f"h_{j}_{k}") for j, k in HALF],
        *[F.sum(F.col("miss") * F.col(f"v{j}")).alias(f"g_{j}") for j in range(INPUTS)],
        F.coalesce(F.sum(F.when(F.col("is_train"), F.col("square"))), F.lit(0.0)).alias("on_train"),
        F.sum(F.when(~F.col("is_train"), F.col("square"))).alias("on_val"),
    ).select("key", "setting", "output", F.array(*[f"h_{j}_{k}" for j, k in HALF]).alias("h"),
             F.array(*[f"g_{j}" for j in range(INPUTS)]).alias("g"), "on_train", "on_val")


def damped_step(half, gradient, add):
    """Solutions of (matrix + add I) step = gradient for stacked symmetric matrices, given by their ``HALF``."""
    import numpy as np

    full = np.zeros((len(half), INPUTS, INPUTS))
    for at, (j, k) in enumerate(HALF):
        full[:, j, k] = full[:, k, j] = half[:, at]
    full += add[:, None, None] * np.eye(INPUTS)
    lower = np.linalg.cholesky(full)
    return np.linalg.solve(np.swapaxes(lower, 1, 2), np.linalg.solve(lower, gradient[:, :, None]))[:, :, 0]


STATE = ("weights", "matrix", "gradient", "candidate")
NUMBERS = ("loss", "damping", "train_loss", "val_loss")


def advanced(vector: dict, number: dict) -> tuple[dict, dict]:
    """Accept or turn down every candidate and propose the next: the new ``STATE`` and ``NUMBERS``."""
    import numpy as np

    size, ridge = np.maximum(number["n_train"], 1), number["ridge"]
    mean = number["on_train"] / size
    loss = mean + ridge * (vector["candidate"] ** 2).sum(axis=1)
    taken = np.isnan(number["loss"]) | (loss < number["loss"])

    def choose(new, old):
        return np.where(taken[:, None] if new.ndim > 1 else taken, new, old)
    out = {"weights": choose(vector["candidate"], vector["weights"]),
           "matrix": choose(vector["h"] / size[:, None], vector["matrix"]),
           "gradient": choose(vector["g"] / size[:, None] + ridge[:, None] * vector["candidate"], vector["gradient"])}
    best = {"loss": choose(loss, number["loss"]),
            "damping": number["damping"] * np.where(taken, 1 / EASE, EASE),
            "train_loss": choose(mean, number["train_loss"]),
            "val_loss": choose(number["on_val"] / np.maximum(number["n_val"], 1), number["val_loss"])}
    out["candidate"] = out["weights"] - damped_step(out["matrix"], out["gradient"], ridge + best["damping"])
    return out, best


def _advance(batches):
    """``advanced`` on rows with the sums of a pass."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        vector = {c: np.array(batch.column(c).flatten().to_numpy(zero_copy_only=False)).reshape(n, -1)
                  for c in (*STATE, "h", "g")}
        number = {c: np.array(batch.column(c).to_numpy(zero_copy_only=False), dtype=float)
                  for c in ("n_train", "n_val", "ridge", "on_train", "on_val", *NUMBERS)}
        out, best = advanced(vector, number)
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * out[c].shape[1], pa.int32()), pa.array(out[c].ravel()))
                 for c in STATE]
        kept = ("key", "setting", "output", "ridge", "n_train", "n_val")
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *lists, *(pa.array(best[c]) for c in NUMBERS)],
                                         names=[*kept, *STATE, *NUMBERS])


def input_arrays(kind: str, columns: dict, known):
    """``input_columns`` as arrays (input, row)."""
    import numpy as np

    p, q, s = (np.stack([columns[f"{c}{i}"] for i in range(DIM)]) for c in "pqs")
    if kind == "diff":
        p, q = p - s, q - s
    elif kind == "weighted":
        p, q = p * columns["a"], q * columns["b"]
    elif kind != "linear":
        raise ValueError(f"unknown kind {kind}")
    return np.concatenate([p, q, s, np.ones((1, len(known)))])


def local_fit_rows(x, y, known, known_y, train, val, starts, ridge: float, passes: int) -> dict:
    """All passes over rows that are sorted by key; ``starts``: the first row of every key.

    ``x`` (input, row), ``y`` and ``known_y`` (output, row). Returns the weights (key, output, input), n_train, n_val
    and the mean losses (key, pass)."""
    import numpy as np

    def by_key(values):
        return np.add.reduceat(values, starts)
    n, sizes = len(starts), np.diff(np.append(starts, x.shape[1]))
    n_train, n_val = by_key(train.astype(np.int64)), by_key(val.astype(np.int64))
    shape = {"weights": INPUTS, "matrix": len(HALF), "gradient": INPUTS, "candidate": INPUTS}
    vector = {c: np.zeros((n * DIM, w)) for c, w in shape.items()}
    number = {"n_train": np.repeat(n_train, DIM).astype(float), "n_val": np.repeat(n_val, DIM).astype(float),
              "ridge": np.full(n * DIM, ridge), "damping": np.full(n * DIM, DAMPING),
              **{c: np.full(n * DIM, np.nan) for c in ("loss", "train_loss", "val_loss")}}
    losses = {"train_loss": [], "val_loss": []}
    for _ in range(passes):
        half, gradient = np.zeros((n, DIM, len(HALF))), np.zeros((n, DIM, INPUTS))
        on_train, on_val = np.zeros((n, DIM)), np.zeros((n, DIM))
        for o in range(DIM):
            candidate = vector["candidate"].reshape(n, DIM, INPUTS)[:, o]
            e = np.tanh(sum(np.repeat(candidate[:, j], sizes) * x[j] for j in range(INPUTS)))
            sure = known & known_y[o]
            miss = np.where(sure, e - y[o], 0.0)
            v = x * np.where(train & known, 1 - e * e, 0.0)
            for at, (j, k) in enumerate(HALF):
                half[:, o, at] = by_key(v[j] * v[k])
            for j in range(INPUTS):
                gradient[:, o, j] = by_key(miss * v[j])
            on_train[:, o] = by_key(np.where(train, miss * miss, 0.0))
            on_val[:, o] = np.where(by_key(val & sure) > 0, by_key(np.where(val, miss * miss, 0.0)), np.nan)
        sums = {"h": half.reshape(n * DIM, -1), "g": gradient.reshape(n * DIM, -1)}
        vector, best = advanced({**vector, **sums}, {**number, "on_train": on_train.ravel(), "on_val": on_val.ravel()})
        number = {**number, **best}
        for c, kept in losses.items():
            kept.append(best[c].reshape(n, DIM).sum(axis=1) / DIM)
    return {"weights": vector["weights"].reshape(n, DIM, INPUTS), "n_train": n_train, "n_val": n_val,
            **{c: np.stack(kept, axis=1) for c, kept in losses.items()}}


def _fit_bucket(settings: Sequence[dict], passes: int, more: Sequence[str], key_type):
    """One row per key and setting of a group of rows."""
    def run(table):
        import numpy as np
        import pyarrow as pa

        keys = table["key"].combine_chunks().dictionary_encode()
        which = keys.indices.to_numpy()
        order = np.argsort(which, kind="stable")
        table = table.take(pa.array(order))
        starts = np.flatnonzero(np.diff(which[order], prepend=-1))
        train, val = local_fit.sides(table)
        names = [c for c in local_fit.vector_columns(DIM) if c[0] != "y"]
        columns, known = local_fit.numbers(table, names)
        columns = dict(zip(names, columns))
        y, known_y = zip(*(local_fit.numbers(table, [f"y{i}"]) for i in range(DIM)))
        known_of = {}
        for c in more:
            (columns[c],), known_of[c] = local_fit.numbers(table, [c])
        parts = []
        for s in settings:
            sure = known
            for c in more if s["kind"] == "weighted" else ():
                sure = sure & known_of[c]
            fit = local_fit_rows(input_arrays(s["kind"], columns, sure), np.concatenate(y), sure, known_y, train, val, starts,
                                 float(s.get("ridge", RIDGE)), passes)
            n = len(starts)
            lists = [pa.array([row.tolist() if has else [None] * passes for row, has in zip(fit[c], fit[f"n_{c[:-5]}"] > 0)],
                              pa.list_(pa.float64())) for c in ("train_loss", "val_loss")]
            parts.append(pa.table(
                [keys.dictionary.cast(key_type), pa.array(np.full(n, int(s["setting"])), pa.int32()),
                 pa.array(fit["n_train"], pa.int64()), pa.array(fit["n_val"], pa.int64()),
                 *(pa.array(fit["weights"][:, i, j]) for i, j in CELLS), *lists],
                ["key", "setting", "n_train", "n_val", *(f"t_{i}_{j}" for i, j in CELLS), "train_loss", "val_loss"]))
        return pa.concat_tables(parts)
    return run


def fit_least_squares(pairs: DataFrame, passes: int = PASSES, key: str = "user_id", kind: str = "linear",
                      ridge: float = RIDGE, settings: Sequence[dict] | None = None,
                      most: int = local_fit.LOCAL_ROWS) -> DataFrame:
    """Fit one model per key and setting (setting, kind, ridge) in ``passes`` passes over the rows.

    ``pairs``: key, p, q, s, y, split, and a, b for ``weighted``. Returns key, setting, n_train, n_val, the cells
    t_i_j of the best W and the losses of the best weights after each pass (the first: of zero). Keys of more than
    ``most`` rows are fitted by aggregations over all tasks.
    """
    settings = list(settings or [{"setting": 0, "kind": kind, "ridge": ridge}])
    more = ["a", "b"] if any(s["kind"] == "weighted" for s in settings) else []
    rows, n, large = local_fit.split_by_size(pairs, key, DIM, [F.col(c).cast("double").alias(c) for c in more], most)
    name = rows.schema["key"].dataType
    cells = ", ".join(f"t_{i}_{j} double" for i, j in CELLS)
    schema = (f"key {name.simpleString()}, setting int, n_train long, n_val long, {cells}, "
              "train_loss array<double>, val_loss array<double>")
    asked = rows.select("key", "is_train", *local_fit.vector_columns(DIM, more))
    fits = local_fit.in_buckets(asked, n).applyInArrow(_fit_bucket(settings, passes, more, to_arrow_type(name)), schema)
    fits = materialize(fits).withColumnRenamed("key", key)
    if large is not None:
        fits = fits.unionByName(_fit_by_passes(local_fit.vectors(large, key, DIM, more), passes, key, settings))
    return fits


def _fit_by_passes(pairs: DataFrame, passes: int, key: str, settings: Sequence[dict]) -> DataFrame:
    """``fit_least_squares`` with every pass as an aggregation over all tasks."""
    rows = training_rows(pairs, key, settings)
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    state = rows.groupBy("key", "setting", "ridge").agg(
        F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_val")).select(
        "key", "setting", F.explode(F.array(*map(F.lit, range(DIM)))).alias("output"), "ridge", "n_train", "n_val",
        zeros(INPUTS).alias("weights"), zeros(len(HALF)).alias("matrix"), zeros(INPUTS).alias("gradient"),
        zeros(INPUTS).alias("candidate"), F.lit(float("nan")).alias("loss"), F.lit(DAMPING).alias("damping"),
        F.lit(float("nan")).alias("train_loss"), F.lit(float("nan")).alias("val_loss"))
    schema = state.schema
    history = None
    for turn in range(passes):
        met = state.join(_pass(rows, state), ["key", "setting", "output"])
        state = materialize(met.mapInArrow(_advance, schema))
        losses = state.select("key", "setting", F.lit(turn).alias("turn"), "train_loss", "val_loss")
        history = losses if history is None else history.union(losses)
    mean = lambda total, n: F.when(F.col(n) > 0, F.sum(total) / DIM)
    each = (history.join(state.select("key", "setting", "n_train", "n_val").distinct(), ["key", "setting"])
            .groupBy("key", "setting", "turn", "n_train", "n_val")
            .agg(mean("train_loss", "n_train").alias("train"), mean("val_loss", "n_val").alias("val"))
            .groupBy("key", "setting", "n_train", "n_val")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "train", "val"))).alias("l"))
            .select("key", "setting", "n_train", "n_val", F.col("l.train").alias("train_loss"), F.col("l.val").alias("val_loss")))
    cells = state.groupBy("key", "setting").agg(
        *[F.max(F.when(F.col("output") == i, F.col("weights")[j])).alias(f"t_{i}_{j}") for i, j in CELLS])
    return (each.join(cells, ["key", "setting"])
            .select("key", "setting", "n_train", "n_val", *[f"t_{i}_{j}" for i, j in CELLS], "train_loss", "val_loss")
            .withColumnRenamed("key", key))
