"""Vector and matrix arithmetic as Spark column expressions.

Vectors are ``ARRAY<DOUBLE>``, matrices ``ARRAY<ARRAY<DOUBLE>>`` (row major).
Sums run left to right, so results are reproducible.

Most functions take an optional static size ``n`` (or ``rows`` / ``cols``). With
it the arithmetic is unrolled into element expressions (``v[i]``), which
whole-stage code generation compiles; without it the generic higher-order
functions (``transform`` / ``aggregate`` / ``zip_with``) are used, which work
for any length but are evaluated by the interpreter.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(expr, fn) -> Column:
    """Evaluate ``expr`` once and pass it to ``fn`` as a lambda variable.

    Column expressions are trees, so a sub-expression used twice is computed
    twice; inside nested higher-order functions that grows quickly. Binding it
    through a one-element ``transform`` computes it once per row.
    """
    return F.element_at(F.transform(F.array(_c(expr)), fn), 1)


def _sum(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _vec(n: int, fn) -> Column:
    return F.array(*[fn(i) for i in range(n)])


def total(v, n: int | None = None) -> Column:
    if n:
        return _sum([_c(v)[i] for i in range(n)])
    return F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b, n: int | None = None) -> Column:
    if n:
        return _sum([_c(a)[i] * _c(b)[i] for i in range(n)])
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def matvec(w, x, rows: int | None = None, cols: int | None = None) -> Column:
    """W x for a row-major matrix W (rows x cols when given)."""
    if rows and cols:
        return _vec(rows, lambda i: _sum([_c(w)[i][j] * _c(x)[j] for j in range(cols)]))
    return let(x, lambda xx: F.transform(_c(w), lambda row: dot(row, xx)))


def add(*vs, n: int | None = None) -> Column:
    if n:
        return _vec(n, lambda i: _sum([_c(v)[i] for v in vs]))
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [_c(v) for v in vs])


def sub(a, b, n: int | None = None) -> Column:
    if n:
        return _vec(n, lambda i: _c(a)[i] - _c(b)[i])
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def scale(v, s, n: int | None = None) -> Column:
    s = _c(s) if isinstance(s, str) else (s if isinstance(s, Column) else F.lit(s))
    if n:
        return _vec(n, lambda i: _c(v)[i] * s)
    return F.transform(_c(v), lambda x: x * s)


def zeros(n: int) -> Column:
    return F.array(*[F.lit(0.0) for _ in range(n)])


def const(n: int, value: float) -> Column:
    return F.array(*[F.lit(float(value)) for _ in range(n)])


def tanh(v, n: int | None = None) -> Column:
    if n:
        return _vec(n, lambda i: F.tanh(_c(v)[i]))
    return F.transform(_c(v), lambda x: F.tanh(x))


def relu(v) -> Column:
    return F.transform(_c(v), lambda x: F.greatest(x, F.lit(0.0)))


def softmax(v) -> Column:
    """exp(x - max) / sum, a stable softmax."""
    return let(v, lambda vv: let(F.transform(vv, lambda x: F.exp(x - F.array_max(vv))),
                                 lambda e: F.transform(e, lambda x: x / total(e))))


def discretize(v, threshold: float = 0.5, n: int | None = None) -> Column:
    """-1, 0 or 1 per component at +-threshold (strict)."""
    def one(x):
        return F.when(x > threshold, F.lit(1.0)).when(x < -threshold, F.lit(-1.0)).otherwise(F.lit(0.0))
    if n:
        return _vec(n, lambda i: one(_c(v)[i]))
    return F.transform(_c(v), one)


def one_hot_argmax(v) -> Column:
    """One-hot of the largest component, first one on ties."""
    return let(v, lambda vv: F.transform(
        vv, lambda x, i: F.when(i + 1 == F.array_position(vv, F.array_max(vv)), F.lit(1.0)).otherwise(F.lit(0.0))))


def concat(*vs) -> Column:
    return F.concat(*[_c(v) for v in vs])
