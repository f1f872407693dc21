"""Queries of order blocks and of the evolution: walks and searches without an SQL form."""

from __future__ import annotations

import re

from ..functions import formula as fm
from ..functions.formula import show
from ..operators import evolve as ev
from ..operators import orderblocks as ob
from ..sources.store import cut
from .base import WITH, bars, q, query, r
from .search import MATRIX, NAMES, fitness_sql, matrix


def flag(x: str, lb: int, agg: str, op: str) -> str:
    left = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {2 * lb} PRECEDING AND {lb + 1} PRECEDING)"
    right = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {lb - 1} PRECEDING AND CURRENT ROW)"
    own = f"lag({x}, {lb}) OVER (PARTITION BY symbol ORDER BY ts)"
    return f"coalesce({own} {op} {agg}({x}) {left} AND {own} {op} {agg}({x}) {right} AND count({x}) {left} = {lb} AND count({x}) {right} = {lb}, false)"


@query(f"{WITH} SELECT symbol, ts, {flag('high', 20, 'max', '>')} AS swing_high, {flag('low', 20, 'min', '<')} AS swing_low, {flag('high', 5, 'max', '>')} AS inner_high, {flag('low', 5, 'min', '<')} AS inner_low FROM b")
def order_block_pivots(spark, sf):
    return bars(spark, sf).select("symbol", "ts", ob.pivot("high", 20, True).alias("swing_high"), ob.pivot("low", 20, False).alias("swing_low"), ob.pivot("high", 5, True).alias("inner_high"), ob.pivot("low", 5, False).alias("inner_low"))


@query()
def order_blocks(spark, sf):
    """The zones' walk; the tests hold it against a plain version."""
    return ob.order_blocks(bars(spark, sf))


TREES = ["add(f0, f1)", "sub(f0, f1)", "mul(f0, add(f1, f2))", "max(f3, f0)", "add(f0, f2)"]
TREE_SQL = "t AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in TREES) + "]) AS a), g AS (SELECT a, list_distinct(list_transform(range(1, greatest(length(a) - 2, 1) + 1), lambda i: substring(a, i, 3))) AS x FROM t)"


@query(f"WITH {TREE_SQL} SELECT p.a, q.a AS b, len(list_intersect(p.x, q.x)) / len(list_distinct(list_concat(p.x, q.x))) AS jaccard FROM g p JOIN g q ON p.a < q.a")
def elite_distances(spark, sf):
    return ev.formula_distances(spark.createDataFrame([(x,) for x in TREES], "formula string"))


#: A fixed population, to hold scores against SQL.
POPULATION = ["add(f0, mul(f1, f2))", "sub(f1, neg(f3))", "if_then(gt(f0, f2), f1, neg(f3))", "max(min(f0, f1), mul(f2, 0.5))", "div(add(f0, f1), sub(f2, f3))", "f1"]


def penalty_sql(text: str) -> str:
    nodes = len(re.findall(r"[A-Za-z_]\w*|-?\d+\.\d+", text))
    features = len(set(re.findall(r"\bf\d\b", text)))
    return f"(0.02 * greatest(0, 8 - {nodes}) + 0.15 * greatest(0, 3 - {features}) + 0.001 * {nodes})"


@query(f"{WITH}, {MATRIX} " + " UNION ALL ".join(f"SELECT '{t}' AS formula, {q(fitness_sql(fm.to_sql(t)) + ' - ' + penalty_sql(t))} AS score FROM m" for t in POPULATION))
def program_scores(spark, sf):
    """Scores of a population over all rows of all symbols, with both penalties."""
    s = ev.Settings(population=60, generations=3, phases=(1, 1, 1))
    scores = ev.score_rows(matrix(spark, sf), [fm.parse(t) for t in POPULATION], NAMES, "y", 0.001, s)
    return spark.createDataFrame(list(zip(POPULATION, scores)), "formula string, score double").withColumn("score", r("score"))


@query()
def evolution(spark, sf):
    """A small seeded search over all bars of all symbols; the tests hold its invariants, and ``program_scores`` its scores."""
    s = ev.Settings(population=60, generations=3, phases=(1, 1, 1))
    out = ev.evolve_rows(cut(matrix(spark, sf)), NAMES, "y", ["symbol", "ts"], s, seed=3)
    return spark.createDataFrame([(show(p), float(x), len(p)) for p, x in zip(out.population, out.scores)], "formula string, score double, nodes int")
