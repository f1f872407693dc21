"""Features of bars: frames of plain window expressions, and scans for the exponentially weighted ones.

Every frame shares the partitioning by symbol and the order by time, so the frame features of a table
cost one exchange. Features that need moments of the whole series have a causal variant that uses the rows so far.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.series import EPS, bars_window, clip, cumulative_log_return, diff, lag, log_return, midpoint, rolling, rolling_mean, rolling_std, trailing, true_range

#: A range below this is none.
FLAT = 1e-6


@dataclass(frozen=True)
class Profile:
    """Windows of the features; the defaults are those of half-hour bars, thirteen a day."""

    span: int = 260
    horizons: tuple[int, ...] = (1, 3, 6, 13, 26, 65, 130, 260)
    macd: tuple[tuple[int, int], ...] = ((8, 24), (26, 78), (52, 156))
    price_std: int = 260
    signal_std: int = 3276
    efficiency: int = 26
    icp: int = 13
    rsi: int = 14
    asymmetry: int = 20
    structure: int = 65
    squeeze: tuple[int, int] = (5, 30)
    ichimoku: tuple[int, int, int] = (9, 26, 52)
    session: tuple[str, str] = ("09:15", "15:30")
    target_clip: float = 20.0
    causal: bool = False


#: For series of some hundred bars.
SHORT = Profile(span=26, horizons=(1, 3, 6, 13), macd=((8, 24),), price_std=26, signal_std=63, structure=26, ichimoku=(9, 26, 40))


def efficiency(n: int) -> Column:
    """Net move over the path walked, with the move's sign."""
    move = diff("close", n)
    path = rolling(F.sum, F.abs(diff_column("close")), n)
    return clip(F.abs(move) / (path + EPS) * F.signum(move), -1.0, 1.0)


def diff_column(x: str) -> Column:
    """The step column that with_steps() adds; windows can't be nested."""
    return F.col(f"_d_{x}")


def with_steps(bars: DataFrame) -> DataFrame:
    """Columns that several features build on: close's step, log return, true range."""
    return bars.withColumns({"_d_close": diff("close"), "_r": log_return(), "_tr": true_range(), "_icp": bar_position()})


def bar_position() -> Column:
    span = F.col("high") - F.col("low")
    raw = F.when(span < FLAT, 0.5).otherwise((F.col("close") - F.col("low")) / (span + EPS))
    return clip(raw, 0.0, 1.0) * 2 - 1


def internal_close_position(n: int) -> Column:
    return clip(rolling_mean("_icp", n), -1.0, 1.0)


def vol_asymmetry(n: int) -> Column:
    least = max(n // 6, 4)
    side = lambda keep: rolling_std(F.when(keep, F.col("_r")), n, least)
    up, down = side(F.col("_r") > 0), side(F.col("_r") < 0)
    return clip((up - down) / (up + down + EPS), -1.0, 1.0)


def local_structure(n: int) -> Column:
    low, high = rolling(F.min, "low", n), rolling(F.max, "high", n)
    raw = F.when(high - low < FLAT, 0.5).otherwise((F.col("close") - low) / (high - low + EPS))
    return clip(F.when(high.isNotNull(), raw) * 2 - 1, -1.0, 1.0)


def session_position(session: tuple[str, str], ts: str = "ts") -> Column:
    start, end = (int(x[:2]) * 60 + int(x[3:]) for x in session)
    minute = F.hour(ts) * 60 + F.minute(ts)
    return (F.least(F.greatest(minute, F.lit(start)), F.lit(end)) - start) / float(end - start)


def squeeze(fast: int, slow: int) -> Column:
    return rolling_mean("_tr", fast) / (rolling_mean("_tr", slow) + EPS)


def rejection(upper: bool) -> Column:
    span = F.col("high") - F.col("low") + EPS
    wick = F.col("high") - F.greatest("open", "close") if upper else F.least("open", "close") - F.col("low")
    return clip(wick / span, 0.0, 1.0)


def ichimoku(bars: DataFrame, periods: tuple[int, int, int]) -> DataFrame:
    fast, base, slow = periods
    raw = bars.withColumns({"_tenkan": midpoint(fast), "_kijun": midpoint(base), "_slow": midpoint(slow)})
    raw = raw.withColumns({"_span_a": lag((F.col("_tenkan") + F.col("_kijun")) / 2, base), "_span_b": lag("_slow", base)})
    far = lambda x: (F.col("close") - F.col(x)) / (F.col("close") + EPS)
    return raw.withColumns({f"feat_ichimoku_dist_{x}": far(f"_{x}") for x in ("tenkan", "kijun", "span_a", "span_b")}).drop("_tenkan", "_kijun", "_slow", "_span_a", "_span_b")


def frame_features(bars: DataFrame, p: Profile = SHORT) -> DataFrame:
    """Bars with every feature that plain frames express."""
    angle = session_position(p.session) * math.pi
    out = ichimoku(with_steps(bars), p.ichimoku).withColumns(
        {
            "feat_efficiency": efficiency(p.efficiency),
            "feat_icp": internal_close_position(p.icp),
            "feat_vol_asymmetry": vol_asymmetry(p.asymmetry),
            "feat_local_structure": local_structure(p.structure),
            "feat_session_sin": F.sin(angle),
            "feat_session_cos": F.cos(angle),
            "feat_vol_squeeze": squeeze(*p.squeeze),
            "feat_rejection_upper": rejection(True),
            "feat_rejection_lower": rejection(False),
        }
    )
    return out.drop("_d_close", "_r", "_tr", "_icp")


def ewma_volatility(bars: DataFrame, span: int, name: str) -> DataFrame:
    """Root of the exponentially weighted variance of log returns about their weighted mean."""
    alpha, seed = 2.0 / (span + 1), min(span, 30)
    out = scan.seeded_ewma(bars.withColumn("_r", log_return()), {"_mu": ("_r", alpha, seed)})
    out = scan.seeded_ewma(out.withColumn("_dev", (F.col("_r") - F.col("_mu")) ** 2), {"_var": ("_dev", alpha, seed)})
    return out.withColumn(name, F.sqrt("_var")).drop("_r", "_mu", "_dev", "_var")


def whole(causal: bool):
    """All rows of the symbol, or the rows so far."""
    w = bars_window()
    return w.rowsBetween(Window.unboundedPreceding, 0 if causal else Window.unboundedFollowing)


def volatility_features(bars: DataFrame, p: Profile = SHORT, target: bool = False) -> DataFrame:
    """Volatility, returns in its units, its scaling factor, and the next bar's return as a target on request."""
    sigma = f"ewma_vol_span{p.span}"
    out = ewma_volatility(bars, p.span, sigma)
    s = F.when(F.col(sigma) > EPS, F.col(sigma))

    def normal(h: int) -> Column:
        scale = F.col(sigma) * math.sqrt(h)
        return F.when(scale > EPS, cumulative_log_return(h) / scale)

    out = out.withColumns({f"ret_norm_{h}d": normal(h) for h in p.horizons} | {"_lv": F.when(s.isNotNull(), F.ln(F.greatest(1 / s, F.lit(EPS))))})
    z = (F.col("_lv") - F.avg("_lv").over(whole(p.causal))) / F.stddev_samp("_lv").over(whole(p.causal))
    out = out.withColumn(f"vs_factor_span{p.span}", clip(z, -5.0, 5.0)).drop("_lv")
    if target:
        out = out.withColumn("target_norm_ret", clip(F.ln(lag("close", -1) / F.col("close")) / s, -p.target_clip, p.target_clip))
    return out


def macd(bars: DataFrame, short: int, long: int, price_std: int, signal_std: int) -> DataFrame:
    """Difference of two means in units of the price's, then of its own deviation. Both means start after ``short`` values."""
    out = scan.seeded_ewma(bars, {"_s": ("close", 2.0 / (short + 1), short), "_l": ("close", 2.0 / (long + 1), short)})
    out = out.withColumn("_p", rolling_std("close", price_std)).withColumn("_q", F.when(F.col("_p") > EPS, (F.col("_s") - F.col("_l")) / F.col("_p")))
    out = out.withColumn("_qs", rolling_std("_q", signal_std))
    return out.withColumn(f"macd_{short}_{long}", F.when(F.col("_qs") > EPS, F.col("_q") / F.col("_qs"))).drop("_s", "_l", "_p", "_q", "_qs")


def momentum_rsi(bars: DataFrame, n: int = 14, name: str = "feat_momentum_rsi") -> DataFrame:
    """Wilder's relative strength about 0, from -1 to 1."""
    step = diff("close")
    out = bars.withColumns({"_up": F.greatest(step, F.lit(0.0)), "_down": F.greatest(-step, F.lit(0.0))})
    out = out.withColumns({"_up": F.when(step.isNotNull(), F.col("_up")), "_down": F.when(step.isNotNull(), F.col("_down"))})
    out = scan.seeded_ewma(out, {"_au": ("_up", 1.0 / n, n), "_ad": ("_down", 1.0 / n, n)})
    rsi = 100 - 100 / (1 + F.col("_au") / (F.col("_ad") + EPS))
    return out.withColumn(name, (rsi - 50) / 50).drop("_up", "_down", "_au", "_ad")


def sma_atr(n: int) -> Column:
    """Over the column ``_tr``."""
    return rolling_mean("_tr", n)


def wilder_atr(bars: DataFrame, n: int = 14, name: str = "atr") -> DataFrame:
    return scan.wilder(bars.withColumn("_tr", true_range()), name, "_tr", n).drop("_tr")


def ewm_atr(bars: DataFrame, n: int = 14, name: str = "atr") -> DataFrame:
    return scan.ewm(bars.withColumn("_tr", true_range()), {name: ("_tr", 1.0 / n)}, adjust=False, least=n).drop("_tr")


@dataclass(frozen=True)
class Buckets:
    """How each feature is scaled later: passed through, or by a fitted tanh."""

    through: tuple[str, ...] = field(default=("feat_efficiency", "feat_icp", "feat_momentum_rsi", "feat_vol_asymmetry", "feat_local_structure", "feat_session_sin", "feat_session_cos", "feat_rejection_upper", "feat_rejection_lower"))

    def split(self, columns: list[str]) -> tuple[list[str], list[str]]:
        return [x for x in columns if x in self.through], [x for x in columns if x not in self.through]


def build(bars: DataFrame, p: Profile = SHORT, target: bool = False, inference: bool = False, drop_missing: bool = False) -> DataFrame:
    """Every native feature of every symbol. A target looks ahead, so it is refused in inference."""
    if target and inference:
        raise RuntimeError("a target needs the next bar, which inference does not have")
    out = volatility_features(frame_features(bars, p), p, target)
    for short, long in p.macd:
        out = macd(out, short, long, p.price_std, p.signal_std)
    out = momentum_rsi(out, p.rsi)
    return out.na.drop("any") if drop_missing else out


def feature_tensor(features: DataFrame, columns: list[str], target: str | None = None) -> DataFrame:
    """ts, x (a row of numbers per symbol, in order of symbol) and y, for the times that every symbol has."""
    k = features.agg(F.count_distinct("symbol").alias("k"))
    row = F.struct("symbol", F.array(*[F.col(x).cast("float") for x in columns]).alias("x"), (F.col(target) if target else F.lit(None)).cast("float").alias("y"))
    by = features.groupBy("ts").agg(F.array_sort(F.collect_list(row)).alias("rows")).join(F.broadcast(k)).where(F.size("rows") == F.col("k"))
    return by.select("ts", F.col("rows.symbol").alias("symbols"), F.col("rows.x").alias("x"), F.col("rows.y").alias("y"))


__all__ = ["Buckets", "Profile", "SHORT", "build", "ewm_atr", "frame_features", "macd", "momentum_rsi", "sma_atr", "trailing", "volatility_features", "wilder_atr"]
