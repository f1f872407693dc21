"""Boards where a slope meets its threshold, or a score its rounding, in the last bit: as in SQL."""

import math

import duckdb
import numpy as np
import pytest

from barloom.functions import moments
from barloom.operators import leaderboard as lb
from barloom.plans import registry

#: Runs of sf0.1 with a slope of -0.2 but for its last bit (251, 263), and with a score of 0.30925 (39).
RUNS = (39, 251, 263)


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("runs"))
    duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.1/orders.parquet' WHERE o_custkey // 10 IN {RUNS}) TO '{sf}/orders.parquet'")
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet'")
    return sf, con


def same(name, spark, runs):
    sf, con = runs
    got = registry.queries()[name](spark, sf)
    want = con.sql(registry.oracle_sql()[name])
    rows = sorted(map(tuple, got.select(*want.columns).collect()), key=str)
    assert len(rows) and rows == sorted(want.fetchall(), key=str)


def test_board_build_at_ties(spark, runs):
    same("board_build", spark, runs)


def test_board_ranks_at_ties(spark, runs):
    same("board_ranks", spark, runs)


def test_board_grade_at_ties(spark, runs):
    same("board_grade", spark, runs)


def test_board_kill_switch_at_ties(spark, runs):
    same("board_kill_switch", spark, runs)


def test_fused_rounds_once():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 20_000))
    c = np.where(rng.random(20_000) < 0.5, rng.normal(size=20_000), -a * b * (1 + rng.integers(-3, 4, 20_000) * 2.0**-52))
    want = [math.fma(*x) for x in zip(a.tolist(), b.tolist(), c.tolist())] if hasattr(math, "fma") else None
    assert want is None or moments.fused(a, b, c).tolist() == want
    assert (a * b + c != moments.fused(a, b, c)).any()


@pytest.mark.parametrize("gaps", [False, True])
def test_forward_walk_to_the_last_bit(spark, gaps):
    """Runs cut by batches, folds without a ratio, two winners of one fold, a run without folds: the SQL's sums bit by bit."""
    rng = np.random.default_rng(5)
    folds = [(f"r{k % 3}", k // 3, None if gaps and k % 7 == 0 else float(rng.integers(-9, 20)) / 10, bool(k % 4 == 0)) for k in range(180)]
    wins = [(r, f"h{r}{f}{x}", f) for r, f, _, w in folds if w for x in (0, 1)] + [("none", "h", 3)]
    f, w = spark.createDataFrame(folds, "run string, fold long, sharpe double, winner boolean"), spark.createDataFrame(wins, "run string, formula_hash string, fold long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {r["formula_hash"]: r for r in lb.forward_walk(w, f).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    con = duckdb.connect()
    con.sql("SET threads = 1")
    assert len(got) == len(wins)
    for run, digest, fold in wins:
        later = [(s, i, x) for i, (s, x) in enumerate(((s, x) for r, o, s, x in folds if r == run and o > fold), 1)]
        g, n = got[digest], len(later)
        assert g["fw_n_folds"] == n and g["fw_data_sufficient"] == (n >= 2)
        if n < 2:
            assert g["fw_std_sharpe"] is None and g["fw_sharpe_decay"] is None and g["fw_positive_folds"] == 0
            continue
        y, i = [s for s, _, _ in later], [float(k) for _, k, _ in later]
        m, sd, sp, k = con.execute("SELECT avg(s), stddev_samp(s), stddev_pop(s), regr_slope(s, i) FROM (SELECT unnest(?::DOUBLE[]) AS s, unnest(?::DOUBLE[]) AS i)", [y, i]).fetchone()
        assert (g["fw_mean_sharpe"], g["fw_std_sharpe"], g["fw_sharpe_decay"]) == (m, sd, k if n >= 3 and sp is not None and sp > 1e-8 else 0.0)
        pos = sum(s is not None and s > 0 for s in y)
        assert g["fw_positive_folds"] == pos and g["fw_survival_rate"] == pos / n and g["fw_winner_folds"] == sum(x for _, _, x in later)
