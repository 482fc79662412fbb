"""Oracle SQL of the tanh fits: one CTE per epoch of full-batch gradient descent."""
from __future__ import annotations

from ..operators.fit import CELLS, DIM, INPUTS


def inputs_sql(kind: str) -> list[str]:
    p, q, s = ([f"{c}{i}" for i in range(DIM)] for c in "pqs")
    if kind == "diff":
        p, q = [f"({x} - {z})" for x, z in zip(p, s)], [f"({x} - {z})" for x, z in zip(q, s)]
    elif kind == "weighted":
        p, q = [f"{x} * a" for x in p], [f"{x} * b" for x in q]
    return [*p, *q, *s, "1.0"]


def fit_ctes(name: str, source: str, key: str, kind: str, lr: float, epochs: int) -> str:
    """CTEs ``{name}_rows``, ``{name}_0`` .. ``{name}_{epochs}``. ``source`` has the key, is_train, p0..,
    q0.., s0.., y0.. and a, b for ``weighted``."""
    xs = ", ".join(f"CAST({x} AS DOUBLE) AS x{j}" for j, x in enumerate(inputs_sql(kind)))
    ys = ", ".join(f"y{i}" for i in range(DIM))
    out = [f"{name}_rows AS MATERIALIZED (SELECT {key} AS key, is_train, {xs}, {ys} FROM ({source}) z)",
           f"{name}_0 AS MATERIALIZED (SELECT key, COUNT(*) FILTER (is_train) AS n_train, COUNT(*) FILTER (NOT is_train) AS n_val, "
           + ", ".join(f"CAST(0 AS DOUBLE) AS t_{i}_{j}" for i, j in CELLS)
           + f", [] :: DOUBLE[] AS train_loss, [] :: DOUBLE[] AS val_loss FROM {name}_rows GROUP BY key)"]
    for n in range(epochs):
        e = [f"tanh({' + '.join(f't_{i}_{j} * x{j}' for j in range(INPUTS))}) AS e{i}" for i in range(DIM)]
        d = [f"CASE WHEN is_train THEN (e{i} - y{i}) * (1 - e{i} * e{i}) ELSE 0 END AS d{i}" for i in range(DIM)]
        sq = " + ".join(f"(e{i} - y{i}) * (e{i} - y{i})" for i in range(DIM))
        g = [f"SUM(d{i} * x{j}) AS g_{i}_{j}" for i, j in CELLS]
        step = f"({lr!r} * 2 / ({DIM} * greatest(n_train, 1)))"
        out.append(f"""{name}_{n + 1} AS MATERIALIZED (
SELECT f.key, n_train, n_val, {', '.join(f't_{i}_{j} - {step} * g_{i}_{j} AS t_{i}_{j}' for i, j in CELLS)},
       list_append(train_loss, on_train / ({DIM} * n_train)) AS train_loss,
       list_append(val_loss, on_val / ({DIM} * n_val)) AS val_loss
FROM {name}_{n} f JOIN (
  SELECT key, {', '.join(g)}, SUM(sq) FILTER (is_train) AS on_train, SUM(sq) FILTER (NOT is_train) AS on_val
  FROM (SELECT *, {', '.join(d)}, {sq} AS sq FROM (
    SELECT r.*, {', '.join(e)} FROM {name}_rows r JOIN {name}_{n} t ON t.key = r.key) u) w
  GROUP BY key) s ON s.key = f.key)""")
    return ",\n".join(out)


def _cholesky_sql(source: str) -> str:
    """``source`` (m_j_k: lower cells of a symmetric matrix, r_j) with the solution s_j, column by column."""
    n = INPUTS
    for j in range(n):
        done = "".join(f" - l_{j}_{k} * l_{j}_{k}" for k in range(j))
        source = f"SELECT *, sqrt(m_{j}_{j}{done}) AS l_{j}_{j} FROM ({source}) d{j}"
        if j + 1 < n:
            below = [f"(m_{i}_{j}{''.join(f' - l_{i}_{k} * l_{j}_{k}' for k in range(j))}) / l_{j}_{j} AS l_{i}_{j}"
                     for i in range(j + 1, n)]
            source = f"SELECT *, {', '.join(below)} FROM ({source}) b{j}"
    for i in range(n):
        source = f"SELECT *, (r_{i}{''.join(f' - l_{i}_{k} * z_{k}' for k in range(i))}) / l_{i}_{i} AS z_{i} FROM ({source}) f{i}"
    for i in reversed(range(n)):
        source = f"SELECT *, (z_{i}{''.join(f' - l_{k}_{i} * s_{k}' for k in range(i + 1, n))}) / l_{i}_{i} AS s_{i} FROM ({source}) w{i}"
    return source


def second_order_ctes(name: str, source: str, key: str, kind: str, passes: int, ridge: float | None = None) -> str:
    """CTEs up to ``{name}_fit`` (key, n_train, n_val, t_i_j, train_loss, val_loss) of the second-order fit."""
    from ..operators.second_order import DAMPING, EASE, HALF, RIDGE

    ridge = RIDGE if ridge is None else ridge
    xs = ", ".join(f"CAST({x} AS DOUBLE) AS x{j}" for j, x in enumerate(inputs_sql(kind)))
    each = range(INPUTS)
    out = [f"{name}_rows AS MATERIALIZED (SELECT {key} AS key, is_train, {xs}, [y0, y1, y2] AS y FROM ({source}) z)",
           f"{name}_0 AS MATERIALIZED (SELECT key, output, n_train, n_val, {DAMPING!r}::DOUBLE AS damping, NULL::DOUBLE AS loss, "
           "NULL::DOUBLE AS train, NULL::DOUBLE AS val, "
           + ", ".join(f"0::DOUBLE AS {c}_{j}" for c in "wgc" for j in each) + ", "
           + ", ".join(f"0::DOUBLE AS h_{j}_{k}" for j, k in HALF)
           + f" FROM (SELECT key, COUNT(*) FILTER (is_train) AS n_train, COUNT(*) FILTER (NOT is_train) AS n_val FROM {name}_rows GROUP BY key) n, "
           "(VALUES (0), (1), (2)) o(output))"]
    for t in range(passes):
        v = ", ".join(f"slope * x{j} AS v{j}" for j in each)
        sums = [f"SUM(v{j} * v{k}) AS nh_{j}_{k}" for j, k in HALF] + [f"SUM(miss * v{j}) AS ng_{j}" for j in each]
        new = {f"h_{j}_{k}": f"nh_{j}_{k} / size" for j, k in HALF}
        new |= {f"g_{j}": f"ng_{j} / size + {ridge!r} * c_{j}" for j in each} | {f"w_{j}": f"c_{j}" for j in each}
        new |= {"loss": "here", "train": "on_train / size", "val": "on_val / greatest(n_val, 1)"}
        chosen = ", ".join(f"CASE WHEN taken THEN {e} ELSE {c} END AS {c}" for c, e in new.items())
        state = f"""
SELECT key, output, n_train, n_val, damping * CASE WHEN taken THEN {1 / EASE!r} ELSE {EASE!r} END AS damping, {chosen}
FROM (SELECT *, loss IS NULL OR here < loss AS taken FROM (
  SELECT *, on_train / size + {ridge!r} * ({' + '.join(f'c_{j} * c_{j}' for j in each)}) AS here FROM (
    SELECT p.*, greatest(n_train, 1) AS size, s.* EXCLUDE (key, output) FROM {name}_{t} p JOIN (
      SELECT key, output, {', '.join(sums)}, coalesce(SUM(miss * miss) FILTER (is_train), 0) AS on_train,
             SUM(miss * miss) FILTER (NOT is_train) AS on_val
      FROM (SELECT *, {v} FROM (SELECT *, CASE WHEN is_train THEN 1 - e * e ELSE 0 END AS slope, e - y[output + 1] AS miss FROM (
        SELECT r.*, q.output, tanh({' + '.join(f'c_{j} * x{j}' for j in each)}) AS e
        FROM {name}_rows r JOIN {name}_{t} q ON q.key = r.key) a) b) c
      GROUP BY key, output) s ON s.key = p.key AND s.output = p.output) d) f) g"""
        matrix = ", ".join(f"h_{j}_{k}" + (f" + {ridge!r} + damping" if j == k else "") + f" AS m_{j}_{k}" for j, k in HALF)
        solved = _cholesky_sql(f"SELECT *, {matrix}, {', '.join(f'g_{j} AS r_{j}' for j in each)} FROM ({state}) st")
        kept = "key, output, n_train, n_val, damping, loss, train, val, " + ", ".join(
            [f"{c}_{j}" for c in "wg" for j in each] + [f"h_{j}_{k}" for j, k in HALF])
        out.append(f"{name}_{t + 1} AS MATERIALIZED (SELECT {kept}, {', '.join(f'w_{j} - s_{j} AS c_{j}' for j in each)} FROM ({solved}) so)")
    losses = " UNION ALL ".join(f"SELECT key, n_train, n_val, {t} AS turn, SUM(train) / {DIM} AS train, SUM(val) / {DIM} AS val "
                                f"FROM {name}_{t + 1} GROUP BY key, n_train, n_val" for t in range(passes))
    cells = ", ".join(f"MAX(w_{j}) FILTER (output = {i}) AS t_{i}_{j}" for i, j in CELLS)
    out.append(f"""{name}_fit AS (
SELECT l.*, w.* EXCLUDE (key) FROM (
  SELECT key, n_train, n_val, list(CASE WHEN n_train > 0 THEN train END ORDER BY turn) AS train_loss,
         list(CASE WHEN n_val > 0 THEN val END ORDER BY turn) AS val_loss
  FROM ({losses}) x GROUP BY key, n_train, n_val) l JOIN (SELECT key, {cells} FROM {name}_{passes} GROUP BY key) w ON w.key = l.key)""")
    return ",\n".join(out)
