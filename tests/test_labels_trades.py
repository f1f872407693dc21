"""Labels on a flat market, order blocks against a plain version, and ledgers worked out by hand."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import features as ft
from barloom.operators import labels as lb
from barloom.operators import orderblocks as ob
from barloom.operators import signals as sg


def flat(spark):
    ts = pd.date_range("2024-01-01 09:15", periods=60, freq="30min")
    rows = pd.DataFrame({"symbol": "s", "ts": ts, "open": 100.0, "high": 101.0, "low": 99.0, "close": 100.0})
    rows.loc[30, ["high", "low"]] = [104.0, 96.0]
    return spark.createDataFrame(rows)


def test_both_targets(spark):
    bars = ft.wilder_atr(flat(spark), 3)
    kept = lb.triple_barrier(bars, 5, 1.0, 3.0, exclude_both_tp=False)
    left = lb.triple_barrier(bars, 5, 1.0, 3.0, exclude_both_tp=True)
    assert kept.where("event_type = 'BOTH_TP' and target = 1").count() > 0
    assert left.where("event_type = 'BOTH_TP' and target = 1").count() == 0 and left.where("event_type = 'BOTH_TP' and target = -99").count() > 0
    assert lb.training_rows(left).count() < lb.training_rows(kept).count()
    assert {r["target"] for r in left.select("target").distinct().collect()} <= {1.0, -1.0, 0.0, -99.0}


def test_missing_bar_cuts_the_path(spark):
    bars = ft.wilder_atr(flat(spark), 3).withColumn("high", F.when(F.hour("ts") != 15, F.col("high")))
    assert lb.triple_barrier(bars, 5, 5.0, 9.0).where("not is_valid").count() > 0


def test_target_is_refused_in_inference(spark):
    with pytest.raises(RuntimeError):
        ft.build(flat(spark), target=True, inference=True)


def walk(spark, n=400, seed=4):
    rng = np.random.default_rng(seed)
    c = 100 + np.cumsum(rng.normal(size=n))
    o = np.concatenate(([100], c[:-1]))
    h, low = np.maximum(o, c) + rng.uniform(0, 1, n), np.minimum(o, c) - rng.uniform(0, 1, n)
    return pd.DataFrame({"symbol": "s", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "open": o, "high": h, "low": low, "close": c})


def plain_zones(df, atr_n=14, size=0.5, most=10, overlap=0.85):
    """Supports and resistances by the rules, bar by bar over whole arrays."""
    h, lo, c = (df[x].to_numpy() for x in ("high", "low", "close"))
    n = len(c)
    tr = np.maximum.reduce([h - lo, np.abs(h - np.r_[np.nan, c[:-1]]), np.abs(lo - np.r_[np.nan, c[:-1]])])
    tr[0] = h[0] - lo[0]
    atr = pd.Series(tr).rolling(atr_n).mean().to_numpy()

    def is_pivot(x, j, k):
        return j - k >= 0 and j + k < n and (np.delete(x[j - k : j + k + 1], k) < x[j]).all()

    zones = {(s, kind): [] for s in "RS" for kind in ("swing", "inner")}
    found = []

    def dup(z, others):
        for q in others:
            i = min(z["top"], q["top"]) - max(z["bot"], q["bot"])
            if i > 0 and i / (max(z["top"], q["top"]) - min(z["bot"], q["bot"])) > overlap:
                return True
        return False

    def make(j, i, side):
        if not np.isfinite(atr[j]) or atr[j] <= 0:
            return None
        top, bot = (h[j], h[j] - size * atr[j]) if side == "R" else (lo[j] + size * atr[j], lo[j])
        between = range(j + 1, i)
        if any(c[t] > top if side == "R" else c[t] < bot for t in between):
            return None
        return {"idx": j, "top": top, "bot": bot, "touches": sum(lo[t] <= top and h[t] >= bot for t in between)}

    for i in range(41, n):
        for side, x in (("R", h), ("S", -lo)):
            j = i - 20
            if is_pivot(x, j, 20):
                inner, swing = zones[side, "inner"], zones[side, "swing"]
                old = next((z for z in inner if z["idx"] == j), None)
                z = old or make(j, i, side)
                if z and not dup(z, swing):
                    if old:
                        inner.remove(old)
                    swing.append(z)
                    del swing[:-most]
        for side, x in (("R", h), ("S", -lo)):
            j = i - 5
            if is_pivot(x, j, 5):
                z = make(j, i, side)
                if z and not dup(z, zones[side, "swing"]) and not dup(z, zones[side, "inner"]):
                    zones[side, "inner"].append(z)
                    del zones[side, "inner"][:-most]
        for (side, kind), zs in zones.items():
            for z in zs:
                z["touches"] += lo[i] <= z["top"] and h[i] >= z["bot"]
            zones[side, kind] = [z for z in zs if not (c[i] > z["top"] if side == "R" else c[i] < z["bot"])]
        s = max(zones["S", "swing"], key=lambda z: z["top"], default=None)
        r = min(zones["R", "swing"], key=lambda z: z["bot"], default=None)
        found.append((i, s and s["top"], s["touches"] if s else 0, r and r["bot"], r["touches"] if r else 0))
    return found


def test_order_blocks(spark):
    df = walk(spark)
    got = ob.order_blocks(spark.createDataFrame(df)).orderBy("ts").toPandas()
    c = df["close"].to_numpy()
    some = 0
    for i, s, st, r, rt in plain_zones(df):
        row = got.iloc[i]
        assert (row.feat_ob_supp_mask, row.feat_ob_res_mask) == (float(s is not None), float(r is not None))
        assert (row.feat_ob_supp_touches, row.feat_ob_res_touches) == (st, rt)
        if s is not None:
            some += 1
            assert row.feat_ob_supp_dist == pytest.approx((c[i] - s) / (c[i] + 1e-10))
        else:
            assert row.feat_ob_supp_dist == 5.0
    assert some > 20 and (got.iloc[:41].feat_ob_supp_mask == 0).all()


def ledger(spark, rows):
    cols = "symbol string, ts int, open double, close double, go_long boolean, go_short boolean, tp_pct double, sl_pct double"
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], cols)
    return sg.simulate(df, fees=0.01, slippage=0.0).orderBy("ts").toPandas()


def test_target_and_fees(spark):
    out = ledger(spark, [(100.0, 100.0, True, False, 0.1, 0.1), (100.0, 105.0, False, False, 0.1, 0.1), (105.0, 120.0, False, False, 0.1, 0.1)])
    assert out["why"].tolist() == [None, None, "target"] and out["opened"].tolist() == [1, 0, 0]
    # 1 unit of money buys 0.01; fees 0.01 in and 0.012 out; gain 0.2.
    assert out["gain"][2] == pytest.approx(0.2 - 0.01 - 0.012) and out["equity"][1] == pytest.approx(1 + 0.05 - 0.01)


def test_stop_short_and_opposite(spark):
    out = ledger(spark, [(100.0, 100.0, False, True, 0.5, 0.1), (100.0, 115.0, False, False, 0.5, 0.1), (115.0, 115.0, True, False, 0.5, 0.5), (120.0, 120.0, False, True, 0.5, 0.5), (120.0, 120.0, False, True, 0.5, 0.5)])
    assert out["why"].tolist() == [None, "stop", None, "opposite", None]
    assert out["position"].tolist() == [-1, 0, 1, 0, -1]
    assert out["gain"][1] == pytest.approx(-0.15 - 0.01 - 0.0115)


def test_stats(spark):
    sim = spark.createDataFrame([("s", 0, 1.0, None), ("s", 1, 1.1, 0.1), ("s", 2, 0.99, -0.11)], "symbol string, ts int, equity double, gain double")
    s = sg.portfolio_stats(sim, 252).first()
    assert (s["return_pct"], s["max_dd"], s["win_rate"], s["n_trades"]) == (pytest.approx(-1.0), pytest.approx(10.0), 50.0, 2)
    assert s["profit_factor"] == pytest.approx(0.1 / 0.11)


def test_inputs_are_checked(spark):
    df = spark.createDataFrame([("s", 1, 0.5)], "symbol string, ts int, x double")
    with pytest.raises(ValueError):
        sg.check_inputs(df, "x", 1, 0.85, 0.15)
    with pytest.raises(ValueError):
        sg.check_inputs(df.withColumn("x", F.lit(None).cast("double")), "x", 500, 0.85, 0.15)
