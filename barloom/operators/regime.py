"""Market regimes of symbols: Hurst exponent, directional index and choppiness, and a decision over them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.series import bars_window, lag, true_range

#: Thresholds (fixed values).
HURST_TREND, HURST_REVERT, ADX_TREND, CHOP_TREND, CHOP_CHOPPY = 0.55, 0.45, 25.0, 38.2, 61.8


def hurst(bars: DataFrame, most_lag: int = 50) -> DataFrame:
    """symbol, hurst: slope of ln(deviation of the lag's differences) on ln(lag); NULL for a symbol with too few bars."""
    lags = range(2, most_lag)
    diffs = bars.select("symbol", *[(F.col("close") - lag("close", k)).alias(f"d{k}") for k in lags])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.stddev_pop(f"d{k}").alias("tau")) for k in lags])
    by = diffs.groupBy("symbol").agg(F.count("*").alias("n"), pairs.alias("pairs"))
    long = by.select("symbol", "n", F.explode("pairs").alias("p")).where((F.col("p.lag") < F.floor(F.col("n") / 2)) & (F.col("p.tau") > 0))
    found = long.groupBy("symbol").agg(F.regr_slope(F.ln("p.tau"), F.ln("p.lag")).alias("hurst"))
    return by.select("symbol").join(found, "symbol", "left")


def adx(bars: DataFrame, period: int = 14) -> DataFrame:
    """symbol, adx: the last value of the smoothed directional index. Both moves count, whichever is larger."""
    alpha = 2.0 / (period + 1)
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    x = bars.withColumns({"_tr": true_range(), "_up": F.when(up.isNotNull(), F.greatest(up, F.lit(0.0))), "_down": F.when(down.isNotNull(), F.greatest(down, F.lit(0.0)))})
    x = x.withColumn("_n", F.count("_tr").over(bars_window().rowsBetween(Window.unboundedPreceding, 0)))
    x = scan.ewm(x, {"_a": ("_tr", alpha), "_u": ("_up", alpha), "_d": ("_down", alpha)}, adjust=True)
    atr = F.when((F.col("_n") >= period) & (F.col("_a") != 0), F.col("_a"))
    p, m = 100 * F.col("_u") / atr, 100 * F.col("_d") / atr
    x = x.withColumn("_dx", F.coalesce(F.try_divide(100 * F.abs(p - m), p + m), F.lit(0.0)))
    x = scan.ewm(x.select("symbol", "ts", "_dx"), {"_x": ("_dx", alpha)}, adjust=True)
    return x.groupBy("symbol").agg(F.max_by("_x", "ts").alias("adx"))


def choppiness(bars: DataFrame, period: int = 28) -> DataFrame:
    """symbol, chop over the last ``period`` bars; 100 where nothing moves or too few bars are there."""
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    x = bars.withColumns({"_tr": true_range(), "_last": last}).where(F.col("_last") <= period)
    span = F.max("high") - F.min("low")
    value = 100 * F.log10(F.sum("_tr") / span) / math.log10(period)
    return x.groupBy("symbol").agg(F.when((span == 0) | (F.count("*") < period // 2), 100.0).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(200.0))).alias("chop"))


def decide(h: Column, a: Column, c: Column) -> Column:
    trend = a > ADX_TREND
    return (
        F.when((h > HURST_TREND) & trend, "trending").when(h < HURST_REVERT, "mean_reverting").when(c > CHOP_CHOPPY, "choppy_random_walk")
        .when((c < CHOP_TREND) | trend, "trending_random_walk").otherwise("random_walk")
    )


def classify(bars: DataFrame, most_lag: int = 50) -> DataFrame:
    """symbol, hurst, adx, chop, regime: of every symbol; what is NULL says nothing for a trend or against one."""
    out = hurst(bars, most_lag).join(adx(bars), "symbol", "left").join(choppiness(bars), "symbol", "left")
    return out.withColumn("regime", decide(F.col("hurst"), F.col("adx"), F.col("chop")))


def current_regime(bars: DataFrame, last: int = 858) -> DataFrame:
    """The regime of each symbol's last bars."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    return classify(bars.withColumn("_last", place).where(F.col("_last") <= last).drop("_last"))
