"""SQL text builders for oracle queries (DuckDB dialect)."""

from __future__ import annotations

from collections.abc import Sequence


def union_all(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def quantile_ctes(name: str, src: str, keys: Sequence[str], value: str, probs: Sequence[float]) -> str:
    """CTEs ``{name}_o, {name}_t, {name}`` giving ``(keys, prob, value)`` with NumPy's linear rule.

    ``src`` must expose ``keys`` and ``value`` with nulls removed.
    """
    k = ", ".join(keys)
    kp = f"PARTITION BY {k} " if keys else ""
    ksel = f"{k}, " if keys else ""
    on = " AND ".join([f"t.{c} = o.{c}" for c in keys] + ["TRUE"])
    probs_sql = ", ".join(f"({float(p)!r}::DOUBLE)" for p in probs)
    tk = ", ".join(f"t.{c}" for c in keys)
    tks = f"{tk}, " if keys else ""
    return f"""
{name}_o AS (
  SELECT {ksel}{value} AS v,
    row_number() OVER ({kp}ORDER BY {value}) AS rn,
    count(*) OVER ({kp.strip()}) AS n
  FROM {src}
),
{name}_n AS (SELECT DISTINCT {ksel}n FROM {name}_o),
{name}_p AS (
  SELECT {ksel}n, prob, CAST(n AS DOUBLE) * prob + (1.0::DOUBLE - prob) - 1.0::DOUBLE AS pos
  FROM {name}_n, (VALUES {probs_sql}) AS pr(prob)
),
{name}_t AS (
  SELECT {ksel}prob, pos - floor(pos) AS t,
    least(CAST(floor(pos) AS BIGINT) + 1, n) AS r1,
    least(CAST(floor(pos) AS BIGINT) + 2, n) AS r2
  FROM {name}_p
),
{name} AS (
  SELECT {tks}t.prob,
    CASE WHEN t.t >= 0.5 THEN b.v - (b.v - a.v) * (1.0::DOUBLE - t.t)
         ELSE a.v + (b.v - a.v) * t.t END AS value
  FROM {name}_t t
  JOIN {name}_o a ON {on.replace('o.', 'a.')} AND a.rn = t.r1
  JOIN {name}_o b ON {on.replace('o.', 'b.')} AND b.rn = t.r2
)"""


def r2(expr: str) -> str:
    return f"round_even(({expr}) * 100.0, 0) / 100.0"


def r3(expr: str) -> str:
    return f"round_even(({expr}) * 1000.0, 0) / 1000.0"
