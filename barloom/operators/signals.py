"""From scores to trades: causal ranks, entries, execution, a barrier simulation and its statistics.

Rules of the simulation, per symbol and in order of time:

1. A signal acts on the next bar. A bar whose range measure or open is missing takes no entry.
2. Without a position, an entry buys (or sells short) at the bar's open, made worse by the slippage, with all equity.
3. With a position, a signal of the other side closes it at the bar's open; one of the same side does nothing.
4. Take-profit and stop-loss lie at fixed shares of the entry price, taken at the entry bar. They are checked on each bar's close,
   the entry bar's too, stop first, and close the position at that close.
5. Fees are a share of the traded value, on both sides. Equity is marked at each close; an open position is not closed at the end.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequential import walk
from ..functions.series import bars_window, lag, rank_in

FEES, SLIPPAGE = 0.0003, 0.0001


def entries(df: DataFrame, score: str, window: int = 500, long_level: float = 0.85, short_level: float = 0.15, floor: float = 0.01) -> DataFrame:
    """``rank``, ``long_entry`` and ``short_entry``; a bar that asks for both sides gets none.

    One frame without a least size serves: in a symbol's first rows it equals the expanding rank.
    """
    out = df.withColumn("rank", rank_in(score, window))
    out = out.withColumns({"_l": (F.col("rank") >= long_level) & (F.col(score) >= floor), "_s": (F.col("rank") <= short_level) & (F.col(score) <= -floor)})
    return out.withColumns({"long_entry": F.col("_l") & ~F.col("_s"), "short_entry": F.col("_s") & ~F.col("_l")}).drop("_l", "_s")


def executable(df: DataFrame, atr: str = "atr", tp: float = 3.5, sl: float = 2.0) -> DataFrame:
    """``go_long`` and ``go_short`` one bar after the entry, where barriers exist; ``tp_pct`` and ``sl_pct``."""
    fine = F.col(atr).isNotNull() & F.col("open").isNotNull() & (F.col("open") > 0) & (F.col(atr) > 0)
    pct = lambda m: F.when(fine, F.col(atr) / F.col("open") * m)
    late = lambda c: F.coalesce(lag(c), F.lit(False)) & fine
    return df.withColumns({"go_long": late("long_entry"), "go_short": late("short_entry"), "tp_pct": pct(tp), "sl_pct": pct(sl)})


def coverage(df: DataFrame, key: str = "symbol") -> DataFrame:
    n = lambda c: F.count_if(F.col(c))
    return df.groupBy(key).agg(
        n("long_entry").alias("n_long_raw"), n("short_entry").alias("n_short_raw"), n("go_long").alias("n_long"), n("go_short").alias("n_short"),
        ((n("long_entry") + n("short_entry")) / F.count("*") * 100).alias("raw_coverage_pct"), ((n("go_long") + n("go_short")) / F.count("*") * 100).alias("coverage_pct"),
    )


def check_inputs(df: DataFrame, score: str, window: int, long_level: float, short_level: float) -> None:
    """Raise on levels out of order, a window below 2, and missing scores."""
    if not 0 <= short_level < long_level <= 1 or window < 2:
        raise ValueError("levels must be in order and the window 2 or more")
    if df.where(F.col(score).isNull() | F.isnan(score)).limit(1).count():
        raise ValueError("scores are missing")


def simulator(fees: float, slippage: float) -> Callable[[], Callable[..., tuple]]:
    def machine() -> Callable[..., tuple]:
        equity, side, entry, units, paid, tp, sl = 1.0, 0, 0.0, 0.0, 0.0, 0.0, 0.0

        def close_at(price: float) -> float:
            """Profit of the trade that ends at ``price``."""
            nonlocal equity, side
            out = price * (1 - side * slippage)
            gain = side * units * (out - entry) - paid - abs(units) * out * fees
            equity += gain
            side = 0
            return gain

        def step(o, c, go_long, go_short, tp_pct, sl_pct) -> tuple:
            nonlocal side, entry, units, paid, tp, sl
            gain, opened, why = None, 0, None
            want = (1 if go_long else 0) - (1 if go_short else 0)
            if side and want == -side and o is not None:
                gain, why = close_at(o), "opposite"
            elif not side and want and o is not None and equity > 0:
                side, entry = want, o * (1 + want * slippage)
                units = equity / entry
                paid = equity * fees
                tp, sl, opened = tp_pct, sl_pct, want
            if side and c is not None:
                move = side * (c - entry) / entry
                if move <= -sl:
                    gain, why = close_at(c), "stop"
                elif move >= tp:
                    gain, why = close_at(c), "target"
            marked = equity + (side * units * (c - entry) - paid if side and c is not None else 0.0)
            return side, opened, gain, why, marked

        return step

    return machine


def simulate(df: DataFrame, fees: float = FEES, slippage: float = SLIPPAGE) -> DataFrame:
    """symbol, ts, position, opened, gain, why, equity of each bar."""
    return walk(df, simulator(fees, slippage), ["open", "close", "go_long", "go_short", "tp_pct", "sl_pct"], "position int, opened int, gain double, why string, equity double", ["symbol", "ts"])


def portfolio_stats(sim: DataFrame, bars_per_year: float = 13 * 252, key: str = "symbol") -> DataFrame:
    """Total return, Sharpe ratio, worst drawdown, win rate (all but the ratio in percent), profit factor and trades of each symbol."""
    w = bars_window(key)
    top = F.greatest(F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    own = sim.withColumns({"_r": F.col("equity") / F.coalesce(F.lag("equity").over(w), F.lit(1.0)) - 1, "_dd": 1 - F.col("equity") / top})
    won, lost = F.sum(F.when(F.col("gain") > 0, F.col("gain"))), -F.sum(F.when(F.col("gain") <= 0, F.col("gain")))
    out = own.groupBy(key).agg(
        ((F.max_by("equity", "ts") - 1) * 100).alias("return_pct"),
        F.coalesce(F.try_divide(F.avg("_r"), F.stddev_samp("_r")) * math.sqrt(bars_per_year), F.lit(0.0)).alias("sharpe"),
        (F.max("_dd") * 100).alias("max_dd"),
        F.try_divide(F.count_if(F.col("gain") > 0) * 100.0, F.count("gain")).alias("win_rate"),
        F.try_divide(F.coalesce(won, F.lit(0.0)), lost).alias("profit_factor"),
        F.count("gain").alias("n_trades"),
    )
    return out
