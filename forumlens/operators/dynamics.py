"""State-transition steps as column expressions, with per-user weights joined in.

States are ``ARRAY<DOUBLE>`` of length d. Each step is one pass of higher-order
functions over a row; weights are attached by an equi-join on the user.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .training import spread_join


def linear_step(p, q, s, w_p="w_p", w_q="w_q", w_s="w_s", b="b", d: int | None = None) -> Column:
    """tanh(W_p p + W_q q + W_s s + b)  (J03); ``d`` unrolls for a known state size."""
    return A.tanh(A.add(A.matvec(w_p, p, d, d), A.matvec(w_q, q, d, d), A.matvec(w_s, s, d, d), b, n=d), d)


def diff_step(p, q, s, w_p="w_p", w_q="w_q", w_s="w_s", b="b", d: int | None = None) -> Column:
    """tanh(W_p (p - s) + W_q (q - s) + W_s s + b)  (J04)."""
    return A.tanh(A.add(A.matvec(w_p, A.sub(p, s, d), d, d), A.matvec(w_q, A.sub(q, s, d), d, d),
                        A.matvec(w_s, s, d, d), b, n=d), d)


def weighted_step(p, p_strength, q, q_strength, s, w_p="w_p", w_q="w_q", w_s="w_s", b="b",
                  d: int | None = None) -> Column:
    """tanh((W_p p) a + (W_q q) b + W_s s + bias), strengths a, b scale the parents' pull."""
    return A.tanh(A.add(A.scale(A.matvec(w_p, p, d, d), p_strength, d),
                        A.scale(A.matvec(w_q, q, d, d), q_strength, d),
                        A.matvec(w_s, s, d, d), b, n=d), d)


def network_step(x, layers: list[tuple], out: tuple) -> Column:
    """Feed-forward step: ReLU layers then a softmax output layer."""
    h = x if isinstance(x, Column) else F.col(x)
    for w, bias in layers:
        h = A.let(A.add(A.matvec(w, h), bias), A.relu)
    w_o, b_o = out
    return A.softmax(A.add(A.matvec(w_o, h), b_o))


def stacked_rows(*mats) -> Column:
    """[M1 | M2 | ...]: row i is the concatenation of row i of every matrix."""
    first = F.col(mats[0]) if isinstance(mats[0], str) else mats[0]
    rest = [F.col(m) if isinstance(m, str) else m for m in mats[1:]]
    return F.transform(first, lambda row, i: F.concat(row, *[r[i] for r in rest]))


# --- step graph (nodes x steps) ---------------------------------------------------

def _zeros3():
    from ..functions.arrays import zeros
    return zeros(3)


def parent_states(nodes: DataFrame) -> DataFrame:
    """For every node row with parents: the first parent (the article) state and
    strength, and the optional second parent (a comment) state and strength, or
    zeros and strength 0 (D09). Two equi-joins on (node_id, k, run)."""
    lookup = nodes.select(F.col("node_id").alias("_pid"), F.col("k").alias("_pk"), "metadata_id",
                          F.col("state").alias("_st"), F.col("strength").alias("_sg"))
    rows = nodes.where(F.size("parent_ids") > 0).select(
        "node_id", "k", "metadata_id", "state",
        F.try_element_at("parent_ids", F.lit(1)).alias("_p1"), F.try_element_at("parent_ks", F.lit(1)).alias("_k1"),
        F.try_element_at("parent_ids", F.lit(2)).alias("_p2"), F.try_element_at("parent_ks", F.lit(2)).alias("_k2"))
    first = lookup.select(F.col("_pid").alias("_p1"), F.col("_pk").alias("_k1"), "metadata_id",
                          F.col("_st").alias("p"), F.col("_sg").alias("a"))
    second = lookup.select(F.col("_pid").alias("_p2"), F.col("_pk").alias("_k2"), "metadata_id",
                           F.col("_st").alias("_q"), F.col("_sg").alias("_b"))
    found = rows.join(first, ["_p1", "_k1", "metadata_id"])
    out = (spread_join(found, second, ["_p2", "_k2", "metadata_id"], ["node_id", "k"])
               .withColumn("q", F.coalesce("_q", _zeros3()))
               .withColumn("b", F.coalesce("_b", F.lit(0.0))))
    return out.select("node_id", "k", "metadata_id", "state", "p", "a", "q", "b")


def previous_states(nodes: DataFrame, lag: int = 1) -> DataFrame:
    """State of the same node at k - lag (D10): a self equi-join on (node, k, run),
    balanced because (node, k) is unique."""
    prev = nodes.select("node_id", (F.col("k") + lag).alias("k"), "metadata_id",
                        F.col("state").alias("s"))
    return nodes.select("node_id", "k", "metadata_id").join(prev, ["node_id", "k", "metadata_id"])


def graph_tuples(nodes: DataFrame, target_lead: int = 0) -> DataFrame:
    """Training tuples (W09): parents at k with the previous state at k-1 and the
    target at k (default, K11), or with ``target_lead=1`` the previous state at k
    and the target at k+1."""
    parents = parent_states(nodes)
    if target_lead == 0:
        prev = previous_states(nodes, 1)
        return (parents.join(prev, ["node_id", "k", "metadata_id"])
                       .select("node_id", "k", "metadata_id", "p", "a", "q", "b", "s",
                               F.col("state").alias("y")))
    nxt = nodes.select("node_id", (F.col("k") - target_lead).alias("k"), "metadata_id",
                       F.col("state").alias("y"))
    return (parents.join(nxt, ["node_id", "k", "metadata_id"])
                   .select("node_id", "k", "metadata_id", "p", "a", "q", "b",
                           F.col("state").alias("s"), "y"))
