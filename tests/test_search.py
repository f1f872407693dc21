import hashlib

import numpy as np
import pytest

from barloom.functions.formula import features_used, parse, show
from barloom.operators import evolve as ev
from barloom.operators import leaderboard as lb

SMALL = ev.Settings(population=150, generations=5, phases=(1, 2, 2))


def data():
    x = np.random.default_rng(3).normal(size=(500, 6)).astype(np.float32)
    return {f"f{i}": x[:, i].astype(float) for i in range(6)}, np.where(x[:, 0] > 0, 1.0, -1.0)


def test_smoke_and_reruns():
    columns, y = data()
    a, b = (ev.evolve(columns, y, SMALL, seed=7) for _ in range(2))
    assert a.best == b.best and a.scores == b.scores
    assert len(a.best) <= 40 and np.isfinite(a.predict(columns, 500)).all()
    assert a.history[-1]["best"] > 0.3 and "f0" in features_used(a.best)


def test_on_executors_as_here(spark):
    columns, y = data()
    programs = [parse(x) for x in ("add(f0, f1)", "mul(f2, neg(f3))", "div(f0, f0)")]
    assert ev.score_population(spark, programs, columns, y, 0.001, SMALL) == ev.score_population(None, programs, columns, y, 0.001, SMALL)


def test_prior_rules_the_draw():
    import random

    m = ev.Maker([f"f{i}" for i in range(6)], [0.9] + [0.02] * 5, SMALL, random.Random(1))
    drawn = [x for _ in range(400) for x in m.tree(2, 4) if isinstance(x, str) and x.startswith("f") and x[1:].isdigit()]
    assert drawn.count("f0") / len(drawn) > 0.60


def test_phases_must_add_up():
    with pytest.raises(ValueError):
        ev.Settings(generations=10)
    assert ev.for_regime(SMALL, "none such") == ev.for_regime(SMALL, "random_walk")


def test_elite_keeps_copies_down_and_spreads():
    programs = [parse("add(a, b)")] * 5 + [parse("mul(c, d)"), parse("add(a, c)"), parse("if_then(x, y, z)")]
    got = [show(p) for p in ev.elite(programs, [9, 8, 7, 6, 5, 4, 3, 2], 3, 2, 0.34)]
    assert got[0] == "add(a, b)" and got.count("add(a, b)") <= 2 and len(got) == 3


def test_stale_best_empties_the_pool():
    columns, y = data()
    r = ev.evolve(columns, y, ev.Settings(population=20, generations=1, phases=(1, 0, 0)), seed=1)
    s = ev.Outer([], {"f1": 10.0, "f2": 1.0}, [])
    for _ in range(3):
        s = ev.outer_step(s, r, "h", SMALL, size=10)
    assert s.pool == [] and s.losses == {"f1": 3}


def plain_draws(draws, trades, seed=42):
    u = lambda d, i, k: (int(hashlib.md5(f"{seed}:{d}:{i}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return np.array([[np.sqrt(-2 * np.log(u(d, i, "r"))) * np.cos(2 * np.pi * u(d, i, "a")) for i in range(1, trades + 1)] for d in range(draws)])


def test_significance(spark):
    rows = [("a", 5, 3.0), ("b", 200, 0.5), ("c", 200, 9.0), ("d", 200, -9.0), ("e", None, 1.0), ("f", 40, 1.0)]
    got = {r["h"]: r["p_value"] for r in lb.significance(spark.createDataFrame(rows, "h string, n_trades int, sharpe double"), 300).collect()}
    assert got["a"] == 1.0 and got["c"] == 0.0 and got["d"] == 1.0 and got["e"] == 1.0 and 0.2 < got["b"] < 0.42
    x = plain_draws(300, 200)
    assert abs(x.mean()) < 0.02 and abs(x.std() - 1) < 0.02
    for name, n, s in (("b", 200, 0.5), ("f", 40, 1.0)):
        y = x[:, :n]
        assert got[name] == pytest.approx((y.mean(1) / y.std(1) * np.sqrt(n) >= s).mean())


def test_scores_over_rows_as_over_a_matrix(spark):
    """Batches of any size add up to the score of the whole matrix; what is not finite anywhere is rejected."""
    columns, y = data()
    programs = [parse(x) for x in ("add(f0, f1)", "mul(f2, neg(f3))", "if_then(gt(f0, f1), f2, 0.5)", "div(f0, sub(f1, f1))", "0.25")]
    rows = [(i, float(t), *(float(columns[f"f{k}"][i]) for k in range(6))) for i, t in enumerate(y)]
    df = spark.createDataFrame(rows, "row long, y double, " + ", ".join(f"f{k} double" for k in range(6))).repartition(7)
    got = ev.score_rows(df, programs, list(columns), "y", 0.001, SMALL)
    assert got == pytest.approx(ev.score_population(None, programs, columns, y, 0.001, SMALL), abs=1e-9)
    assert ev.score_rows(df.limit(0), programs, list(columns), "y", 0.001, SMALL) == [ev.REJECTED] * 5
    r = ev.evolve_rows(df, list(columns), "y", ["row"], ev.Settings(population=40, generations=2, phases=(1, 1, 0)), seed=7)
    again = ev.evolve_rows(df.repartition(3), list(columns), "y", ["row"], ev.Settings(population=40, generations=2, phases=(1, 1, 0)), seed=7)
    assert r.best == again.best and "f0" in features_used(r.best)


def test_promotion_by_trades():
    columns, y = data()
    r = ev.evolve(columns, y, ev.Settings(population=30, generations=1, phases=(1, 0, 0)), seed=2)
    assert ev.promote(r, lambda p: -len(p), 10) == min((p for p, x in zip(r.population[:10], r.scores[:10]) if x > ev.REJECTED), key=len)
    assert ev.promote(ev.Result(None, 0.0, [], [], []), len) is None


def test_regimes_change_settings():
    for name, change in ev.BY_REGIME.items():
        s = ev.for_regime(SMALL, name)
        assert all(getattr(s, k) == v for k, v in change.items()) and s.population == SMALL.population


def test_seeds_lose_unknown_features():
    import random

    m = ev.Maker(["f0"], None, SMALL, random.Random(2))
    assert features_used(m.sane(parse("add(zz, f0)"))) <= {"f0"}


def test_kinds_of_normalization(spark):
    from barloom.operators.indicators import normalized

    df = spark.createDataFrame([("s", i, 10.0, 1.0, x, float(i % 2)) for i, x in enumerate([0.0, 1.0, 100.0, None])], "symbol string, ts int, close double, ta_atr double, x double, m double")
    out = normalized(df, ["x", "m"], kinds={"x": "skewed_positive", "m": "mask"}).orderBy("ts").toPandas()
    logs = np.log([1e-8, 1.0, 100.0])
    np.testing.assert_allclose(out["x"], [*((logs - logs.mean()) / logs.std()), np.nan])
    assert out["m"].tolist() == [0.0, 1.0, 0.0, 1.0]
