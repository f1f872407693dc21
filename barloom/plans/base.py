"""What all registered queries share: rounding, the bar table, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bars import hourly_bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(x: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding 0.0 turns -0.0 into 0.0."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def shown(df: DataFrame, *columns: str, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Keys and rounded columns."""
    return df.select(*keys, *[r(c).alias(c) for c in columns])


def q(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


bars = hourly_bars

BARS = """bars AS MATERIALIZED (
  SELECT e.event_type AS symbol, date_trunc('hour', e.ts) AS ts, first(e.value ORDER BY e.ts, e.event_id) AS open, max(e.value) AS high,
         min(e.value) AS low, last(e.value ORDER BY e.ts, e.event_id) AS close, count(*) AS volume
  FROM events e WHERE e.value > 0 GROUP BY e.event_type, date_trunc('hour', e.ts)
), b AS MATERIALIZED (
  SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS c1,
         greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, ln(close / lag(close) OVER w) AS lr
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)
)"""
WITH = f"WITH RECURSIVE {BARS}"
OVER = "OVER (PARTITION BY symbol ORDER BY ts)"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    return f"(CASE WHEN count({x}) {frame(n)} >= {n if least is None else least} THEN {agg}({x}) {frame(n)} END)"


def seeded(name: str, src: str, x: str, alpha: float, seed: int) -> str:
    """CTEs ending in ``name``(symbol, rn, y): the seeded recursion over src(symbol, rn, x)."""
    so_far = "OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{name}_p AS MATERIALIZED (SELECT symbol, rn, {x} AS x, count({x}) {so_far} AS k, avg({x}) {so_far} AS m FROM {src}),
{name} AS (
  SELECT symbol, rn, m AS y FROM {name}_p WHERE k = {seed} AND x IS NOT NULL
  UNION ALL
  SELECT p.symbol, p.rn, CASE WHEN p.x IS NULL THEN e.y ELSE {alpha!r} * p.x + (1 - {alpha!r}) * e.y END
  FROM {name} e JOIN {name}_p p ON p.symbol = e.symbol AND p.rn = e.rn + 1
)"""


def plain_ewm(name: str, src: str, x: str, alpha: float, adjust: bool) -> str:
    """CTEs ending in ``name``(symbol, rn, y) for series without gaps."""
    step = f"p.x + (1 - {alpha!r}) * e.s, 1 + (1 - {alpha!r}) * e.v" if adjust else f"{alpha!r} * p.x + (1 - {alpha!r}) * e.s, 1.0::DOUBLE"
    return f"""{name}_p AS MATERIALIZED (SELECT symbol, rn, {x} AS x FROM {src}),
{name}_r(symbol, rn, s, v) AS (
  SELECT symbol, rn, x, 1.0::DOUBLE FROM {name}_p WHERE rn = 1
  UNION ALL
  SELECT p.symbol, p.rn, {step} FROM {name}_r e JOIN {name}_p p ON p.symbol = e.symbol AND p.rn = e.rn + 1
), {name} AS (SELECT symbol, rn, s / v AS y FROM {name}_r)"""
