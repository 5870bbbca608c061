"""Shared text fragments of the SQL checks. They work on long (id, k, z) rows, not on arrays."""

from __future__ import annotations


def fold(k: str = "k", shift: int = 0, count: int = 10) -> str:
    """Sum of every ``count``-th embedding entry from ``k`` on, after a rotation by ``shift``."""
    term = "CAST(embedding[({} + {}) % 64 + 1] AS DOUBLE)"
    return " + ".join(f"CASE WHEN {k} + {m} < 64 THEN {term.format(k, m + shift)} ELSE 0.0 END" for m in range(0, 64, count))


# (id, label, k, z): ten-way logits of the embeddings table.
CHOICE10 = f"""z0 AS (
  SELECT vec_id AS id, label, k, 4 * ({fold()}) AS z
  FROM embeddings CROSS JOIN range(0, 10) r(k))"""

SOFT10 = f"""t0 AS (
  SELECT id, k, e / sum(e) OVER (PARTITION BY id) AS t
  FROM (SELECT vec_id AS id, k, exp(4 * ({fold(shift=20)})) AS e
        FROM embeddings CROSS JOIN range(0, 10) r(k)))"""


def softmax(src: str = "z0", out: str = "p0", key: str = "id") -> str:
    """CTEs that add p, lse and the first mode to long logits."""
    return f"""{out}_m AS (SELECT *, max(z) OVER (PARTITION BY {key}) AS zmax FROM {src}),
{out}_s AS (SELECT *, sum(exp(z - zmax)) OVER (PARTITION BY {key}) AS mass FROM {out}_m),
{out}_p AS (SELECT *, exp(z - zmax) / mass AS p, zmax + ln(mass) AS lse FROM {out}_s),
{out} AS (SELECT *, first_value(k) OVER (PARTITION BY {key} ORDER BY p DESC, k) AS mode,
  max(p) OVER (PARTITION BY {key}) AS top FROM {out}_p)"""


def r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


ECE = """(SELECT sum(abs(a - b)) / sum(w) FROM (
  SELECT least(9, CAST(floor(top * 10) AS INTEGER)) AS bin, sum(weight) AS w,
         sum(weight * top) AS a, sum(weight * accuracy) AS b FROM q GROUP BY 1))"""
