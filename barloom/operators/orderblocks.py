"""Supply and demand zones at pivots, kept while price respects them.

Pivots are plain frames: a bar is one if its extreme is strictly beyond all of ``lookback`` bars on both sides, and it is known
``lookback`` bars later. The zones themselves are a bounded machine over each symbol's bars:

* a pivot opens a band of half an ATR at its extreme, unless a close since then has already broken it, or a band that
  overlaps it by more than the limit is there; touches since then count;
* a swing pivot takes over the internal zone of the same bar;
* every bar touches the zones its range meets, and closes beyond a zone end it;
* each of the four lists holds a few zones, and the oldest gives way.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequential import walk
from ..functions.series import EPS, bars_window, clip, rolling_mean, rolling_std, true_range

INTERNAL, SWING = 5, 20
COLUMNS = [f"feat_ob_{s}_{k}" for s in ("supp", "res") for k in ("level", "touches", "mask", "dist")]


def pivot(x: str, lookback: int, high: bool) -> Column:
    """Whether the bar ``lookback`` rows ago was a pivot, as this row knows it."""
    w = bars_window()
    left, right = w.rowsBetween(-2 * lookback, -lookback - 1), w.rowsBetween(1 - lookback, 0)
    own = F.lag(x, lookback).over(w)
    agg = F.max if high else F.min
    beyond = (own > agg(x).over(left)) & (own > agg(x).over(right)) if high else (own < agg(x).over(left)) & (own < agg(x).over(right))
    whole = (F.count(x).over(left) == lookback) & (F.count(x).over(right) == lookback)
    return F.coalesce(beyond & whole, F.lit(False))


class Zones:
    """Bands of one side, oldest first: [row of origin, bottom, top, touches]."""

    def __init__(self, most: int, overlap: float):
        self.rows: deque[list] = deque(maxlen=most)
        self.overlap = overlap

    def covers(self, zone: list) -> bool:
        for _, bottom, top, _ in self.rows:
            common = min(top, zone[2]) - max(bottom, zone[1])
            if common > 0 and common / (max(top, zone[2]) - min(bottom, zone[1])) > self.overlap:
                return True
        return False

    def take(self, origin: int) -> list | None:
        return next((z for z in self.rows if z[0] == origin), None)

    def meet(self, high: float, low: float) -> None:
        for z in self.rows:
            z[3] += low <= z[2] and high >= z[1]

    def end(self, close: float, supply: bool) -> None:
        kept = [z for z in self.rows if not (close > z[2] if supply else close < z[1])]
        if len(kept) < len(self.rows):
            self.rows = deque(kept, maxlen=self.rows.maxlen)


def machine(size: float = 0.5, most: int = 10, overlap: float = 0.85) -> Callable[[], Callable[..., tuple]]:
    def fresh() -> Callable[..., tuple]:
        last: deque[tuple] = deque(maxlen=SWING + 1)
        lists = {(kind, supply): Zones(most, overlap) for kind in ("swing", "inner") for supply in (False, True)}
        row = -1

        def born(back: int, supply: bool) -> list | None:
            """The zone of the bar ``back`` rows ago, if nothing has broken it since."""
            high, low, _, atr = last[-1 - back]
            base = high if supply else low
            if base is None or not atr or atr <= 0:
                return None
            bottom, top = (base - size * atr, base) if supply else (base, base + size * atr)
            touches = 0
            for h, lo, c, _ in list(last)[-back:-1]:
                if c is not None and (c > top if supply else c < bottom):
                    return None
                touches += h is not None and lo is not None and lo <= top and h >= bottom
            return [row - back, bottom, top, touches]

        def step(high, low, close, atr, swing_high, swing_low, inner_high, inner_low) -> tuple:
            nonlocal row
            row += 1
            last.append((high, low, close, atr))
            if row <= 2 * SWING or None in (high, low, close):
                return None, 0.0, None, 0.0
            for supply, flag in ((True, swing_high), (False, swing_low)):
                if not flag:
                    continue
                swing, inner = lists["swing", supply], lists["inner", supply]
                zone = inner.take(row - SWING)
                if zone is not None:
                    if not swing.covers(zone):
                        inner.rows.remove(zone)
                        swing.rows.append(zone)
                elif (zone := born(SWING, supply)) is not None and not swing.covers(zone):
                    swing.rows.append(zone)
            for supply, flag in ((True, inner_high), (False, inner_low)):
                if flag and (zone := born(INTERNAL, supply)) is not None and not lists["swing", supply].covers(zone) and not lists["inner", supply].covers(zone):
                    lists["inner", supply].rows.append(zone)
            for (_, supply), zones in lists.items():
                zones.meet(high, low)
                zones.end(close, supply)
            below = max(lists["swing", False].rows, key=lambda z: z[2], default=None)
            above = min(lists["swing", True].rows, key=lambda z: z[1], default=None)
            return below and below[2], float(below[3]) if below else 0.0, above and above[1], float(above[3]) if above else 0.0

        return step

    return fresh


def order_blocks(bars: DataFrame, atr: int = 14, size: float = 0.5, most: int = 10, overlap: float = 0.85, missing: float = 5.0, causal: bool = False) -> DataFrame:
    """symbol, ts and the eight ``feat_ob_*`` columns; levels are NULL without a zone, distances ``missing``."""
    own = bars.withColumn("_tr", true_range()).withColumn("_atr", rolling_mean("_tr", atr))
    whole = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0 if causal else Window.unboundedFollowing)
    own = own.withColumns(
        {"_sh": pivot("high", SWING, True), "_sl": pivot("low", SWING, False), "_ih": pivot("high", INTERNAL, True), "_il": pivot("low", INTERNAL, False), "_vol": F.coalesce(rolling_std("close", 20, 5), F.stddev_samp("close").over(whole))}
    )
    out = walk(own, machine(size, most, overlap), ["high", "low", "close", "_atr", "_sh", "_sl", "_ih", "_il"], "_s double, _st double, _r double, _rt double", ["symbol", "ts", "close", "_vol"])
    c, vol = F.col("close"), F.col("_vol") + EPS
    far = lambda x: clip((F.col(x) - c) / vol, -6.0, 6.0)
    return out.select(
        "symbol", "ts", far("_s").alias("feat_ob_supp_level"), F.col("_st").alias("feat_ob_supp_touches"), F.col("_s").isNotNull().cast("double").alias("feat_ob_supp_mask"), F.coalesce((c - F.col("_s")) / (c + EPS), F.lit(missing)).alias("feat_ob_supp_dist"),
        far("_r").alias("feat_ob_res_level"), F.col("_rt").alias("feat_ob_res_touches"), F.col("_r").isNotNull().cast("double").alias("feat_ob_res_mask"), F.coalesce((F.col("_r") - c) / (c + EPS), F.lit(missing)).alias("feat_ob_res_dist"),
    )
