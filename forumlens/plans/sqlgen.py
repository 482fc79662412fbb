"""Small helpers that spell out d = 3 vector arithmetic as oracle SQL text."""
from __future__ import annotations

D = 3


def vec(prefix: str, n: int = D) -> list[str]:
    return [f"{prefix}{i}" for i in range(n)]


def dot(ws: list[str], xs: list[str]) -> str:
    return "(" + " + ".join(f"{w} * {x}" for w, x in zip(ws, xs)) + ")"


def matvec(m: str, xs: list[str], n: int = D) -> list[str]:
    """Rows of W x for the weight columns ``{m}_{i}_{j}``."""
    return [dot([f"{m}_{i}_{j}" for j in range(len(xs))], xs) for i in range(n)]


def r6(expr: str) -> str:
    return f"round({expr}, 6)"
