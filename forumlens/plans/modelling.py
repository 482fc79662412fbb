"""State-vector models on the per-user sequences: steps, evaluation, reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import dynamics as Dy
from ..operators import report as R
from ..operators import training
from ..session import materialize, scratch_path
from ..sources.views import STATE_DIM
from .catalog import register
from .sqlgen import matvec

_ORDER = "ORDER BY normalized_posted_time, comment_id DESC"
_INPUTS = """(SELECT user_id, comment_id, normalized_posted_time, a0, a1, a2,
        COALESCE(p0, 0.0) AS q0, COALESCE(p1, 0.0) AS q1, COALESCE(p2, 0.0) AS q2, s0, s1, s2
 FROM vectors_v)"""


def _flat(df, vec_cols, places=6):
    keep = [c for c in df.columns if c not in vec_cols]
    out = [F.col(c) for c in keep]
    for c in vec_cols:
        out += [F.round(F.col(c)[i], places).alias(f"{c}{i}") for i in range(3)]
    return df.select(*out)


def _r(names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _lin_sql(diff=False):
    rows = []
    for i in range(3):
        if diff:
            wp = matvec("wp", ["(a0 - s0)", "(a1 - s1)", "(a2 - s2)"])[i]
            wq = matvec("wq", ["(q0 - s0)", "(q1 - s1)", "(q2 - s2)"])[i]
        else:
            wp = matvec("wp", ["a0", "a1", "a2"])[i]
            wq = matvec("wq", ["q0", "q1", "q2"])[i]
        ws = matvec("ws", ["s0", "s1", "s2"])[i]
        rows.append(f"tanh({wp} + {wq} + {ws} + b_{i})")
    return rows


def _inputs(v):
    """Vectors with weights: p = article, q = parent (zeros when missing), s = own state."""
    x = v.vectors().select("user_id", "comment_id", "normalized_posted_time",
                           F.col("article_vec").alias("p"),
                           F.coalesce("parent_vec", A.zeros(3)).alias("q"),
                           F.col("comment_vec").alias("s"))
    return x.join(v.weights(), "user_id")


_LIN, _DIFF = _lin_sql(), _lin_sql(True)


@register("step_linear", views=("vectors_v", "weights_v"), oracle=f"""
SELECT comment_id, round({_LIN[0]}, 6) AS e0, round({_LIN[1]}, 6) AS e1, round({_LIN[2]}, 6) AS e2
FROM {_INPUTS} v JOIN weights_v w ON w.user_id = v.user_id""")
def step_linear(v):
    """Linear step per comment with the user's weights."""
    return _flat(_inputs(v).select("comment_id", Dy.linear_step("p", "q", "s", d=STATE_DIM).alias("e")), ["e"])


@register("step_discrete", views=("vectors_v", "weights_v"), oracle=f"""
SELECT comment_id,
  {', '.join(f"CASE WHEN {e} > 0.5 THEN CAST(1.0 AS DOUBLE) WHEN {e} < -0.5 THEN CAST(-1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS d{i}" for i, e in enumerate(_LIN))}
FROM {_INPUTS} v JOIN weights_v w ON w.user_id = v.user_id""")
def step_discrete(v):
    """Linear step discretised to -1, 0, 1 at +-0.5."""
    return _flat(_inputs(v).select("comment_id", A.discretize(Dy.linear_step("p", "q", "s", d=STATE_DIM), n=STATE_DIM).alias("d")), ["d"])


@register("step_diff", views=("vectors_v", "weights_v"), oracle=f"""
SELECT comment_id, round({_DIFF[0]}, 6) AS e0, round({_DIFF[1]}, 6) AS e1, round({_DIFF[2]}, 6) AS e2
FROM {_INPUTS} v JOIN weights_v w ON w.user_id = v.user_id""")
def step_diff(v):
    """Difference step, inputs (p - s) and (q - s)."""
    return _flat(_inputs(v).select("comment_id", Dy.diff_step("p", "q", "s", d=STATE_DIM).alias("e")), ["e"])


def _net_sql():
    hidden = []
    for i in range(3):
        terms = [f"wp_{i}_{j} * a{j}" for j in range(3)] + [f"wq_{i}_{j} * q{j}" for j in range(3)] + \
                [f"ws_{i}_{j} * s{j}" for j in range(3)]
        hidden.append(f"greatest(({' + '.join(terms)}) + b_{i}, 0.0)")
    return hidden


_H = _net_sql()


@register("step_network", views=("vectors_v", "weights_v"), oracle=f"""
WITH h AS (SELECT v.comment_id, w.*, {_H[0]} AS h0, {_H[1]} AS h1, {_H[2]} AS h2
           FROM {_INPUTS} v JOIN weights_v w ON w.user_id = v.user_id),
o AS (SELECT comment_id, {', '.join(f"({matvec('ws', ['h0', 'h1', 'h2'])[i]} + 0.0) AS o{i}" for i in range(3))} FROM h),
e AS (SELECT comment_id, exp(o0 - greatest(o0, o1, o2)) AS e0, exp(o1 - greatest(o0, o1, o2)) AS e1,
             exp(o2 - greatest(o0, o1, o2)) AS e2 FROM o)
SELECT comment_id, round(e0 / (e0 + e1 + e2), 6) AS n0, round(e1 / (e0 + e1 + e2), 6) AS n1,
       round(e2 / (e0 + e1 + e2), 6) AS n2 FROM e""")
def step_network(v):
    """One ReLU layer over [p | q | s] (weights [W_p | W_q | W_s], bias b), then W_s and softmax."""
    x = _inputs(v)
    hidden = (Dy.stacked_rows("w_p", "w_q", "w_s"), F.col("b"))
    out = (F.col("w_s"), A.zeros(3))
    net = Dy.network_step(A.concat("p", "q", "s"), [hidden], out)
    return _flat(x.select("comment_id", net.alias("n")), ["n"])


@register("one_hot_state", views=("vectors_v",), oracle="""
SELECT comment_id,
       CASE WHEN s0 >= s1 AND s0 >= s2 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS o0,
       CASE WHEN NOT (s0 >= s1 AND s0 >= s2) AND s1 >= s2 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS o1,
       CASE WHEN NOT (s0 >= s1 AND s0 >= s2) AND NOT (s1 >= s2) THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS o2
FROM vectors_v""")
def one_hot_state(v):
    """One-hot of the largest component (first on ties)."""
    return _flat(v.vectors().select("comment_id", A.one_hot_argmax("comment_vec").alias("o")), ["o"])


@register("ordered_label_scores", views=("vectors_v",), oracle=f"""
SELECT comment_id, {_r(['s0', 's1', 's2'])} FROM vectors_v""".replace(
    "round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2",
    "round(s0, 6) AS v0, round(s1, 6) AS v1, round(s2, 6) AS v2"))
def ordered_label_scores(v):
    """Classifier output (labels sorted by score) put back in the fixed label order."""
    from ..operators.vectors import SENTIMENT_LABELS, classifier_output, in_label_order
    x = v.vectors().select("comment_id", "comment_vec")
    ranked = classifier_output(x, "comment_vec", SENTIMENT_LABELS)
    return _flat(ranked.select("comment_id", in_label_order("labels", "scores", SENTIMENT_LABELS).alias("v")),
                 ["v"])


# --- evaluation -------------------------------------------------------------------

_PAIRS_SQL = f"""
SELECT user_id, comment_id, a0, a1, a2, q0, q1, q2, s0, s1, s2,
       LEAD(s0) OVER (PARTITION BY user_id {_ORDER}) AS y0,
       LEAD(s1) OVER (PARTITION BY user_id {_ORDER}) AS y1,
       LEAD(s2) OVER (PARTITION BY user_id {_ORDER}) AS y2,
       ROW_NUMBER() OVER (PARTITION BY user_id {_ORDER}) - 1 AS idx
FROM {_INPUTS} x"""

_SQERR = " + ".join(f"(e{i} - y{i}) * (e{i} - y{i})" for i in range(3))
_SQERR_DISCRETE = " + ".join(
    f"pow(CASE WHEN e{i} > 0.5 THEN 1.0 WHEN e{i} < -0.5 THEN -1.0 ELSE 0.0 END - y{i}, 2)" for i in range(3))
_EVAL_BASE = f"""
WITH pairs AS (SELECT * FROM ({_PAIRS_SQL}) t WHERE y0 IS NOT NULL),
split AS (SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY md5(CAST(comment_id AS STRING)), comment_id) - 1
                          < floor(COUNT(*) OVER (PARTITION BY user_id) * 8 / 10) THEN 'train' ELSE 'val' END AS split
          FROM pairs),
pred AS (SELECT s.user_id, s.split, s.idx, s.y0, s.y1, s.y2,
                {_LIN[0]} AS e0, {_LIN[1]} AS e1, {_LIN[2]} AS e2
         FROM split s JOIN weights_v w ON w.user_id = s.user_id),
err AS (SELECT user_id, split, idx, {_SQERR} AS sq, {_SQERR_DISCRETE} AS sq_discrete FROM pred)"""


def _pairs_with_pred(v):
    return training.next_state_pairs(v.vectors()).join(v.weights(), "user_id").withColumn("e", Dy.linear_step("p", "q", "s", d=STATE_DIM))


@register("evaluation_by_user", views=("vectors_v", "weights_v"), oracle=_EVAL_BASE + """
SELECT user_id, split, COUNT(*) AS n_pairs, round(SUM(sq) / (3 * COUNT(*)), 6) AS mse, round(SUM(sq), 6) AS sse,
       round(SUM(sq_discrete), 6) AS sse_discrete
FROM err GROUP BY user_id, split""")
def evaluation_by_user(v):
    """N01 (+E08, E09): mean and summed squared error per user and split, and the summed
    error of the discretised prediction."""
    rows = _pairs_with_pred(v).select(
        "user_id", "comment_id", R.squared_error("e", "y", STATE_DIM).alias("sq"),
        R.squared_error(A.discretize("e", n=STATE_DIM), "y", STATE_DIM).alias("sq_discrete"))
    return R.errors_by(training.train_val_split(materialize(rows)), ["user_id", "split"])


@register("batch_mean_loss", views=("vectors_v", "weights_v"), oracle=_EVAL_BASE + """
SELECT user_id, COUNT(*) AS n_batches, round(AVG(batch_loss), 6) AS epoch_loss FROM (
  SELECT user_id, floor(idx / 8) AS batch, AVG(sq / 3) AS batch_loss FROM err GROUP BY user_id, floor(idx / 8)) b
GROUP BY user_id""")
def batch_mean_loss(v):
    """Epoch loss as the mean of batch-of-8 mean losses, batches by rank."""
    pairs = training.next_state_pairs(v.vectors(), index="idx").join(v.weights(), "user_id")
    rows = pairs.withColumn("e", Dy.linear_step("p", "q", "s", d=STATE_DIM))
    return R.epoch_loss(rows.withColumn("sq", R.squared_error("e", "y", STATE_DIM)), "user_id", "idx", 8)


@register("plot_series", views=("vectors_v", "weights_v"), oracle=f"""
WITH pr AS (
  SELECT v.user_id, v.comment_id, v.normalized_posted_time, v.s0 - v.s2 AS actual,
         {_LIN[0]} AS e0, {_LIN[2]} AS e2
  FROM {_INPUTS} v JOIN weights_v w ON w.user_id = v.user_id),
al AS (
  SELECT user_id, comment_id, normalized_posted_time, actual,
         COALESCE(LAG(e0) OVER (PARTITION BY user_id {_ORDER}), 2.0)
           - COALESCE(LAG(e2) OVER (PARTITION BY user_id {_ORDER}), 2.0) AS predicted
  FROM pr)
SELECT user_id, comment_id, normalized_posted_time, 'actual' AS series, round(actual, 6) AS value FROM al
UNION ALL
SELECT user_id, comment_id, normalized_posted_time, 'predicted' AS series, round(predicted, 6) AS value FROM al""")
def plot_series(v):
    """Actual and predicted sentiment scalar per user and time, long form."""
    x = _inputs(v).withColumn("pred", Dy.linear_step("p", "q", "s", d=STATE_DIM))
    al = training.aligned_predictions(x.select("user_id", "comment_id", "normalized_posted_time", "s", "pred"),
                                      "pred")
    wide = al.select("user_id", "comment_id", "normalized_posted_time",
                     (F.col("s")[0] - F.col("s")[2]).alias("actual"),
                     (F.col("aligned_pred")[0] - F.col("aligned_pred")[2]).alias("predicted"))
    return R.long_form(wide, ["user_id", "comment_id", "normalized_posted_time"], ["actual", "predicted"])


@register("graph_state_series", views=("nodes_v",), oracle="""
SELECT node_id, k, 0 AS dim, round(x0, 6) AS value FROM nodes_v WHERE node_type = 'user'
UNION ALL SELECT node_id, k, 1 AS dim, round(x1, 6) AS value FROM nodes_v WHERE node_type = 'user'
UNION ALL SELECT node_id, k, 2 AS dim, round(x2, 6) AS value FROM nodes_v WHERE node_type = 'user'""")
def graph_state_series(v):
    """Graph states per node, step and dimension (long form)."""
    n = v.graph().where(F.col("node_type") == "user")
    return n.select("node_id", "k", F.posexplode("state").alias("dim", "value")) \
            .select("node_id", "k", "dim", F.round("value", 6).alias("value"))


@register("training_export", views=("nodes_v",), oracle="""
SELECT node_id, COUNT(*) AS n_steps,
       round(arg_min(x0, k), 6) AS first0, round(arg_min(x1, k), 6) AS first1, round(arg_min(x2, k), 6) AS first2,
       round(arg_max(x0, k), 6) AS last0, round(arg_max(x1, k), 6) AS last1, round(arg_max(x2, k), 6) AS last2
FROM nodes_v WHERE node_type = 'user' GROUP BY node_id""")
def training_export(v):
    """Nested JSON export (run metadata + per-node step lists), read back and summarised."""
    spark = v.spark
    n = v.graph().where(F.col("node_type") == "user")
    path = scratch_path(spark, "export")
    R.export_nested(n, path, metadata={"state_dim": 3, "k_max": None})
    back = R.read_export(spark, path)
    return _flat(R.summarise_export(back), ["first", "last"])


# --- fits -------------------------------------------------------------------------

from ..operators import fit as Fit  # noqa: E402
from ..operators import second_order as Newton  # noqa: E402
from .fit_sql import fit_ctes, second_order_ctes  # noqa: E402

FIT_PASSES = Newton.PASSES
FIT_EPOCHS = 4
FIT_LR = 0.5
LAYERS = (128, 128)

_FIT_PAIRS = f"""
pairs AS (SELECT * FROM ({_PAIRS_SQL}) t WHERE y0 IS NOT NULL),
fit_input AS (SELECT user_id, a0 AS p0, a1 AS p1, a2 AS p2, q0, q1, q2, s0, s1, s2, y0, y1, y2,
  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY md5(CAST(comment_id AS STRING)), comment_id) - 1
    < floor(COUNT(*) OVER (PARTITION BY user_id) * 8 / 10) AS is_train
  FROM pairs)"""


def _fit_input(v):
    return training.train_val_split(materialize(training.next_state_pairs(v.vectors())))


def _fit_summary(fits, key="user_id"):
    return fits.select(key, "setting", "n_train", "n_val",
                       F.round(F.col("train_loss")[0], 6).alias("first_train_loss"),
                       F.round(F.element_at("train_loss", -1), 6).alias("last_train_loss"),
                       F.round(F.element_at("val_loss", -1), 6).alias("last_val_loss"),
                       *[F.round(c, 4).alias(c) for c in Fit.CELL_NAMES])


def _fit_summary_sql(name, setting=0, key="user_id"):
    return f"""SELECT key AS {key}, {setting} AS setting, n_train, n_val, round(train_loss[1], 6) AS first_train_loss,
       round(train_loss[-1], 6) AS last_train_loss, round(val_loss[-1], 6) AS last_val_loss,
       {", ".join(f"round({c}, 4) AS {c}" for c in Fit.CELL_NAMES)} FROM {name}_fit"""


def _fit_sql(kind):
    return f"WITH {_FIT_PAIRS}, {fit_ctes('f', 'SELECT * FROM fit_input', 'user_id', kind, FIT_LR, FIT_EPOCHS)}\n"


def _second_order_sql(kind):
    return f"WITH {_FIT_PAIRS}, {second_order_ctes('f', 'SELECT * FROM fit_input', 'user_id', kind, FIT_PASSES)}\n"


@register("fit_linear_users", views=("vectors_v",), oracle=_second_order_sql("linear") + _fit_summary_sql("f"))
def fit_linear_users(v):
    """One linear model per user."""
    return _fit_summary(Newton.fit_least_squares(_fit_input(v), FIT_PASSES, kind="linear"))


@register("fit_diff_users", views=("vectors_v",), oracle=_second_order_sql("diff") + _fit_summary_sql("f"))
def fit_diff_users(v):
    """The difference model per user."""
    return _fit_summary(Newton.fit_least_squares(_fit_input(v), FIT_PASSES, kind="diff"))


@register("run_history", views=("vectors_v",), oracle=_fit_sql("linear") + f"""
SELECT key AS user_id, epoch, round(train_loss[epoch + 1], 6) AS train_loss, round(val_loss[epoch + 1], 6) AS val_loss,
       round(t_0_0, 6) AS last_weight
FROM f_{FIT_EPOCHS}, (SELECT CAST(unnest(range({FIT_EPOCHS})) AS INTEGER) AS epoch) n""")
def run_history(v):
    """A run's losses per user and epoch and its weights, stored by run and read back."""
    path = scratch_path(v.spark, "runs")
    Fit.save_run(Fit.fit_tanh(_fit_input(v), FIT_EPOCHS, kind="linear", lr=FIT_LR), path, "linear")
    weights, losses = Fit.read_run(v.spark, path, "linear")
    return (losses.join(weights.select("user_id", F.round("t_0_0", 6).alias("last_weight")), "user_id")
            .select("user_id", "epoch", F.round("train_loss", 6).alias("train_loss"),
                    F.round("val_loss", 6).alias("val_loss"), "last_weight"))


@register("fit_network_users")
def fit_network_users(v):
    """The feed-forward model per user; its layer sizes are a list."""
    fits = Fit.fit_network(_fit_input(v), FIT_EPOCHS, LAYERS, FIT_LR)
    return fits.select("user_id", "n_train", "n_val", F.round(F.col("train_loss")[0], 6).alias("first_train_loss"),
                       F.round(F.element_at("train_loss", -1), 6).alias("last_train_loss"),
                       F.round(F.element_at("val_loss", -1), 6).alias("last_val_loss"),
                       F.size("weights").alias("n_params"))


GRID = [{"setting": i, "kind": k, "ridge": ridge}
        for i, (k, ridge) in enumerate((k, ridge) for k in ("linear", "diff") for ridge in (1e-4, 1e-2))]


@register("fit_grid", views=("vectors_v",), oracle=f"WITH {_FIT_PAIRS}, " + ", ".join(
    second_order_ctes(f"f{s['setting']}x", "SELECT * FROM fit_input", "user_id", s["kind"], FIT_PASSES, s["ridge"]) for s in GRID)
    + "\n" + " UNION ALL ".join(_fit_summary_sql(f"f{s['setting']}x", s["setting"]) for s in GRID))
def fit_grid(v):
    """Settings grid (kind x ridge) x users, fitted together."""
    return _fit_summary(Newton.fit_least_squares(_fit_input(v), FIT_PASSES, settings=GRID))
