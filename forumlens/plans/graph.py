"""Step-graph queries: parents, previous states, tuples, weighted steps, parameters."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import dynamics as Dy
from ..operators import fit as Fit
from ..operators import second_order as Newton
from ..sources.views import STATE_DIM
from .catalog import register
from .fit_sql import second_order_ctes
from .sqlgen import matvec

_X = ["x0", "x1", "x2"]


def _flat(df, vec_cols, places=6):
    keep = [c for c in df.columns if c not in vec_cols]
    out = [F.col(c) for c in keep]
    for c in vec_cols:
        out += [F.round(F.col(c)[i], places).alias(f"{c}{i}") for i in range(3)]
    return df.select(*out)


def _r(names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_PARENTS_SQL = """
SELECT n.node_id, n.k, n.metadata_id, n.x0 AS st0, n.x1 AS st1, n.x2 AS st2,
       a.x0 AS p0, a.x1 AS p1, a.x2 AS p2, a.strength AS a,
       COALESCE(c.x0, 0.0) AS q0, COALESCE(c.x1, 0.0) AS q1, COALESCE(c.x2, 0.0) AS q2,
       COALESCE(c.strength, 0.0) AS b
FROM nodes_v n
JOIN nodes_v a ON a.node_id = n.p1_id AND a.k = n.p1_k AND a.metadata_id = n.metadata_id
LEFT JOIN nodes_v c ON c.node_id = n.p2_id AND c.k = n.p2_k AND c.metadata_id = n.metadata_id
WHERE n.p1_id IS NOT NULL"""


@register("parent_states", views=("nodes_v",), oracle=f"""
SELECT node_id, k, {_r(['p0', 'p1', 'p2', 'a', 'q0', 'q1', 'q2', 'b'])} FROM ({_PARENTS_SQL}) t""")
def parent_states(v):
    """Article parent and optional comment parent of every step."""
    ps = Dy.parent_states(v.nodes())
    return _flat(ps.select("node_id", "k", "p", F.round("a", 6).alias("a"), "q", F.round("b", 6).alias("b")),
                 ["p", "q"])


@register("previous_states", views=("nodes_v",), oracle="""
SELECT n.node_id, n.k, round(p.x0, 6) AS s0, round(p.x1, 6) AS s1, round(p.x2, 6) AS s2
FROM nodes_v n JOIN nodes_v p ON p.node_id = n.node_id AND p.k = n.k - 1 AND p.metadata_id = n.metadata_id""")
def previous_states(v):
    """State at k-1 for every node step."""
    return _flat(Dy.previous_states(v.nodes()).select("node_id", "k", "s"), ["s"])


_TUPLES_SQL = f"""
SELECT t.*, pr.x0 AS s0, pr.x1 AS s1, pr.x2 AS s2, t.st0 AS y0, t.st1 AS y1, t.st2 AS y2
FROM ({_PARENTS_SQL}) t
JOIN nodes_v pr ON pr.node_id = t.node_id AND pr.k = t.k - 1 AND pr.metadata_id = t.metadata_id"""


@register("graph_training_tuples", views=("nodes_v",), oracle=f"""
SELECT node_id, k, {_r(['p0', 'p1', 'p2', 'a', 'q0', 'q1', 'q2', 'b', 's0', 's1', 's2', 'y0', 'y1', 'y2'])}
FROM ({_TUPLES_SQL}) u""")
def graph_training_tuples(v):
    """(parents at k, previous state at k-1) -> target at k."""
    t = Dy.graph_tuples(v.nodes())
    return _flat(t.select("node_id", "k", "p", F.round("a", 6).alias("a"), "q", F.round("b", 6).alias("b"),
                          "s", "y"), ["p", "q", "s", "y"])


def _weighted_sql():
    rows = []
    for i in range(3):
        wp = matvec("wp", ["p0", "p1", "p2"])[i]
        wq = matvec("wq", ["q0", "q1", "q2"])[i]
        ws = matvec("ws", ["s0", "s1", "s2"])[i]
        rows.append(f"tanh({wp} * a + {wq} * b + {ws} + b_{i})")
    return rows


_W = _weighted_sql()
_STEP_SQL = f"""
SELECT u.node_id, u.k, u.y0, u.y1, u.y2, {_W[0]} AS e0, {_W[1]} AS e1, {_W[2]} AS e2
FROM ({_TUPLES_SQL}) u JOIN weights_v w ON u.node_id = w.user_id * 2 + 1"""


def _weighted(v):
    t = Dy.graph_tuples(v.nodes())
    w = (v.weights().withColumn("node_id", F.col("user_id") * 2 + 1).drop("user_id")
          .withColumnRenamed("b", "bias"))
    return t.join(w, "node_id").withColumn("pred", Dy.weighted_step("p", "a", "q", "b", "s", b="bias", d=STATE_DIM))


@register("step_weighted", views=("nodes_v", "weights_v"), oracle=f"""
SELECT node_id, k, {_r(['e0', 'e1', 'e2'])} FROM ({_STEP_SQL}) z""")
def step_weighted(v):
    """tanh(W_p p a + W_q q b + W_s s + bias) for every user step."""
    out = _weighted(v).select("node_id", "k", F.col("pred").alias("e"))
    return _flat(out, ["e"])


@register("graph_predictions", views=("nodes_v", "weights_v"), oracle=f"""
SELECT node_id, k, {_r(['y0', 'y1', 'y2', 'e0', 'e1', 'e2'])},
       CASE WHEN e0 > 0.5 THEN CAST(1.0 AS DOUBLE) WHEN e0 < -0.5 THEN CAST(-1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS d0,
       CASE WHEN e1 > 0.5 THEN CAST(1.0 AS DOUBLE) WHEN e1 < -0.5 THEN CAST(-1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS d1,
       CASE WHEN e2 > 0.5 THEN CAST(1.0 AS DOUBLE) WHEN e2 < -0.5 THEN CAST(-1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS d2
FROM ({_STEP_SQL}) z""")
def graph_predictions(v):
    """J07 (K8): one-step-ahead prediction from the state at k-1, continuous and discrete."""
    out = _weighted(v).select("node_id", "k", "y", F.col("pred").alias("e"),
                              A.discretize("pred", n=STATE_DIM).alias("d"))
    return _flat(out, ["y", "e", "d"])


@register("all_nodes", views=("nodes_v",), oracle=f"""
SELECT node_id, k, node_type, p1_id IS NOT NULL AS has_parents, {_r(_X)} FROM nodes_v""")
def all_nodes(v):
    """Article nodes and user nodes in one table (missing columns NULL)."""
    n = v.graph()
    articles = n.where(F.col("node_type") == "article").select("node_id", "k", "node_type", "state")
    users = n.where(F.col("node_type") == "user").select("node_id", "k", "node_type", "state",
                                                         "parent_ids", "parent_ks")
    both = articles.unionByName(users, allowMissingColumns=True)
    out = both.select("node_id", "k", "node_type",
                      (F.coalesce(F.size("parent_ids"), F.lit(0)) > 0).alias("has_parents"),
                      F.col("state").alias("x"))
    return _flat(out, ["x"])


# --- parameters: estimated against true ------------------------------------------

_CELLS = [f"{m}_{i}_{j}" for m in ("wp", "wq", "ws") for i in range(3) for j in range(3)] + \
         [f"b_{i}" for i in range(3)]
FIT_PASSES = Newton.PASSES
# Estimates of the step graph's weights, under the names of the true ones.
_EST = ", ".join(f"t_{i}_{3 * m + j} AS {name}_{i}_{j}" for m, name in enumerate(("wp", "wq", "ws"))
                 for i in range(3) for j in range(3)) + ", " + ", ".join(f"t_{i}_9 AS b_{i}" for i in range(3))
_EST_SQL = f"""WITH {second_order_ctes('f', f"SELECT *, k % 5 <> 4 AS is_train FROM ({_TUPLES_SQL}) tt", 'node_id',
                                      'weighted', FIT_PASSES)},
est AS (SELECT key AS node_id, 1 AS metadata_id, {_EST} FROM f_fit)
"""


def _true_vs_est(v):
    """D11 (K9): weights fitted on the step graph's tuples with strengths, stored beside the
    true parameters by (node, run)."""
    tuples = Dy.graph_tuples(v.nodes()).withColumn(
        "split", F.when(F.col("k") % 5 != 4, "train").otherwise("val"))
    fits = Newton.fit_least_squares(tuples, FIT_PASSES, key="node_id", kind="weighted")
    est = fits.select("node_id", F.lit(1).alias("metadata_id"),
                      *[c.alias(n) for c, n in zip(Fit.weight_arrays(fits), ("w_p_est", "w_q_est", "w_s_est", "b_est"))])
    true = (v.weights().withColumn("metadata_id", F.lit(1))
            .withColumn("node_id", (F.col("user_id") * 2 + 1).cast("long")))
    return est.join(true, ["node_id", "metadata_id"])


@register("params_true_vs_est", views=("nodes_v", "weights_v"), oracle=_EST_SQL + """
SELECT t.user_id, t.b_0 AS b_true0, t.b_1 AS b_true1, t.b_2 AS b_true2, round(e.b_0, 4) AS b_est0,
       round(e.b_1, 4) AS b_est1, round(e.b_2, 4) AS b_est2, t.wp_1_2 AS wp_true_1_2, round(e.wp_1_2, 4) AS wp_est_1_2
FROM est e JOIN weights_v t ON e.node_id = t.user_id * 2 + 1""")
def params_true_vs_est(v):
    """True parameters next to the estimates."""
    j = _true_vs_est(v)
    return j.select("user_id",
                    *[F.col("b")[i].alias(f"b_true{i}") for i in range(3)],
                    *[F.round(F.col("b_est")[i], 4).alias(f"b_est{i}") for i in range(3)],
                    F.col("w_p")[1][2].alias("wp_true_1_2"), F.round(F.col("w_p_est")[1][2], 4).alias("wp_est_1_2"))


_ABS = [f"abs(e.{c} - t.{c})" for c in _CELLS]


@register("param_error", views=("nodes_v", "weights_v"), oracle=_EST_SQL + f"""
SELECT t.user_id, round(greatest({', '.join(_ABS)}), 4) AS max_abs_error,
       round(({' + '.join(_ABS)}) / {len(_CELLS)}, 4) AS mean_abs_error
FROM est e JOIN weights_v t ON e.node_id = t.user_id * 2 + 1""")
def param_error(v):
    """Largest and mean absolute difference over all parameter cells."""
    j = _true_vs_est(v)
    true_cells = F.concat(F.flatten("w_p"), F.flatten("w_q"), F.flatten("w_s"), F.col("b"))
    est_cells = F.concat(F.flatten("w_p_est"), F.flatten("w_q_est"), F.flatten("w_s_est"), F.col("b_est"))
    diff = F.zip_with(est_cells, true_cells, lambda x, y: F.abs(x - y))
    return j.select("user_id", F.round(F.array_max(diff), 4).alias("max_abs_error"),
                    F.round(A.total(diff) / len(_CELLS), 4).alias("mean_abs_error"))


_TUPLES_LEAD_SQL = f"""
SELECT t.*, t.st0 AS s0, t.st1 AS s1, t.st2 AS s2, nx.x0 AS y0, nx.x1 AS y1, nx.x2 AS y2
FROM ({_PARENTS_SQL}) t
JOIN nodes_v nx ON nx.node_id = t.node_id AND nx.k = t.k + 1 AND nx.metadata_id = t.metadata_id"""


@register("graph_training_tuples_lead", views=("nodes_v",), oracle=f"""
SELECT node_id, k, {_r(['p0', 'p1', 'p2', 'a', 'q0', 'q1', 'q2', 'b', 's0', 's1', 's2', 'y0', 'y1', 'y2'])}
FROM ({_TUPLES_LEAD_SQL}) u""")
def graph_training_tuples_lead(v):
    """W09 with target_lead=1 (K11): parents and state at k -> target at k+1."""
    t = Dy.graph_tuples(v.nodes(), target_lead=1)
    return _flat(t.select("node_id", "k", "p", F.round("a", 6).alias("a"), "q", F.round("b", 6).alias("b"),
                          "s", "y"), ["p", "q", "s", "y"])
