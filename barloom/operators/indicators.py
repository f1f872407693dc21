"""Technical indicators of bars: frames, scans and walks, with names of the form ``ta_<indicator>``.

Conventions: a value is NULL until its windows are full; exponential means start with the plain mean of their
first window; Wilder means do too, and ranges and moves count from the second bar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.sequential import walk
from ..functions.series import bars_window, clip, correlation, lag, rolling, rolling_mean, trailing
from ..sources.store import cut

C, H, L = "close", "high", "low"


def full(agg: Column, x: str, n: int) -> Column:
    return F.when(F.count(x).over(trailing(n)) >= n, agg.over(trailing(n)))


def std_pop(x: str, n: int) -> Column:
    return full(F.stddev_pop(x), x, n)


def weighted(x: str, n: int, weights: list[float]) -> Column:
    """Weights in order from the oldest value, over their sum; from lags, so the frame is bounded."""
    total = sum(weights)
    return sum((lag(x, n - 1 - i) if i < n - 1 else F.col(x)) * (w / total) for i, w in enumerate(weights))


def wma(x: str, n: int) -> Column:
    return weighted(x, n, list(range(1, n + 1)))


def trima(x: str, n: int) -> Column:
    half = (n + 1) // 2
    up = list(range(1, half + 1))
    return weighted(x, n, up + (up[::-1][1:] if n % 2 else up[::-1]))


def price_columns() -> dict[str, Column]:
    c, h, lo = F.col(C), F.col(H), F.col(L)
    return {"ta_medprice": (h + lo) / 2, "ta_typprice": (h + lo + c) / 3, "ta_wclprice": (h + lo + 2 * c) / 4}


def overlap_frames() -> dict[str, Column]:
    mid, sd = rolling_mean(C, 5), std_pop(C, 5)
    return {
        "ta_bbands_0": mid + 2 * sd, "ta_bbands_1": mid, "ta_bbands_2": mid - 2 * sd, "ta_ma": rolling_mean(C, 30), "ta_sma": rolling_mean(C, 30), "ta_wma": wma(C, 30), "ta_trima": trima(C, 30),
        "ta_midpoint": (rolling(F.max, C, 14) + rolling(F.min, C, 14)) / 2, "ta_midprice": (rolling(F.max, H, 14) + rolling(F.min, L, 14)) / 2,
    }


def since_extreme(x: str, n: int, highest: bool) -> Column:
    """Bars since the last extreme among the last n + 1."""
    frame = trailing(n + 1)
    pick = F.max_by if highest else F.min_by
    # Of equal extremes the latest counts: the place breaks ties.
    value = F.struct(F.col(x).alias("v"), (F.col("_n") if highest else -F.col("_n")).alias("t"))
    return F.when(F.count(x).over(frame) > n, F.col("_n") - pick(F.col("_n"), value).over(frame))


def momentum_frames() -> dict[str, Column]:
    """Over bars with ``_n``, the row's number."""
    c = F.col(C)
    up, down = 100 * (14 - since_extreme(H, 14, True)) / 14, 100 * (14 - since_extreme(L, 14, False)) / 14
    before = lag(C, 10)
    fast, slow = rolling_mean(C, 12), rolling_mean(C, 26)
    low, high = rolling(F.min, L, 14), rolling(F.max, H, 14)
    return {
        "ta_mom": c - before, "ta_roc": (F.try_divide(c, before) - 1) * 100, "ta_rocp": F.try_divide(c - before, before), "ta_rocr": F.try_divide(c, before), "ta_rocr100": F.try_divide(c, before) * 100,
        "ta_aroon_0": down, "ta_aroon_1": up, "ta_aroonosc": up - down, "ta_willr": F.when(high > low, -100 * (high - c) / (high - low)).when(high.isNotNull(), 0.0), "ta_apo": fast - slow, "ta_ppo": F.try_divide(fast - slow, slow) * 100,
    }


def cci(bars: DataFrame, n: int = 14) -> DataFrame:
    """Distance of the typical price from its mean over 0.015 of the mean distance."""
    out = bars.withColumn("_tp", (F.col(H) + F.col(L) + F.col(C)) / 3).withColumn("_m", rolling_mean("_tp", n))
    values = F.collect_list("_tp").over(trailing(n))
    far = F.aggregate(F.transform(values, lambda v: F.abs(v - F.col("_m"))), F.lit(0.0), lambda a, x: a + x) / n
    return out.withColumn("_far", far).withColumn("ta_cci", F.when(F.col("_m").isNotNull(), F.coalesce(F.try_divide(F.col("_tp") - F.col("_m"), 0.015 * F.col("_far")), F.lit(0.0)))).drop("_tp", "_m", "_far")


def stochastics(bars: DataFrame) -> DataFrame:
    """Fast (5, 3) and slow (5, 3, 3) stochastics with plain means."""
    low, high = rolling(F.min, L, 5), rolling(F.max, H, 5)
    out = bars.withColumn("ta_stochf_0", F.when(high > low, 100 * (F.col(C) - low) / (high - low)).when(high.isNotNull(), 0.0))
    out = out.withColumn("ta_stochf_1", rolling_mean("ta_stochf_0", 3)).withColumn("ta_stoch_0", F.col("ta_stochf_1"))
    return out.withColumn("ta_stoch_1", rolling_mean("ta_stoch_0", 3))


def ultimate(bars: DataFrame, a: int = 7, b: int = 14, c: int = 28) -> DataFrame:
    before = lag(C)
    low, high = F.when(before.isNotNull(), F.least(L, before)), F.when(before.isNotNull(), F.greatest(H, before))
    out = bars.withColumns({"_bp": F.col(C) - low, "_rg": high - low})
    part = lambda n: F.coalesce(F.try_divide(rolling(F.sum, "_bp", n), rolling(F.sum, "_rg", n)), F.when(rolling(F.sum, "_rg", n).isNotNull(), 0.0))
    return out.withColumn("ta_ultosc", 100 * (4 * part(a) + 2 * part(b) + part(c)) / 7).drop("_bp", "_rg")


def macd_plain(bars: DataFrame) -> DataFrame:
    """Difference of plain means, its mean over 9, and what is left."""
    out = bars.withColumn("ta_macdext_0", rolling_mean(C, 12) - rolling_mean(C, 26))
    out = out.withColumn("ta_macdext_1", rolling_mean("ta_macdext_0", 9))
    return out.withColumn("ta_macdext_2", F.col("ta_macdext_0") - F.col("ta_macdext_1"))


def regression(bars: DataFrame, n: int = 14) -> DataFrame:
    """Line through the last n closes: its slope, angle, start, end and the next value; population deviation and variance over 5."""
    out = bars.withColumn("_x", F.row_number().over(bars_window()).cast("double"))
    w = trailing(n)
    enough = F.count(C).over(w) >= n
    slope = F.when(enough, F.regr_slope(F.col(C), F.col("_x")).over(w))
    mean = F.when(enough, F.avg(C).over(w))
    out = out.withColumns({"ta_linearreg_slope": slope, "_m": mean})
    s = F.col("ta_linearreg_slope")
    start = F.col("_m") - s * (n - 1) / 2
    return out.withColumns(
        {"ta_linearreg_intercept": start, "ta_linearreg": start + s * (n - 1), "ta_tsf": start + s * n, "ta_linearreg_angle": F.degrees(F.atan(s)), "ta_stddev": std_pop(C, 5), "ta_var": full(F.var_pop(C), C, 5)}
    ).drop("_x", "_m")


def pair_statistics(bars: DataFrame) -> DataFrame:
    """Correlation of highs and lows over 30; beta of the second's returns on the first's over 5."""
    w = trailing(30)
    corr = F.try_divide(F.covar_pop(H, L).over(w), F.stddev_pop(H).over(w) * F.stddev_pop(L).over(w))
    ret = lambda x: F.try_divide(F.col(x), lag(x)) - 1
    out = bars.withColumns({"ta_correl": F.when(F.count(H).over(w) >= 30, F.coalesce(corr, F.lit(0.0))), "_a": ret(H), "_b": ret(L)})
    v = trailing(5)
    beta = F.coalesce(F.try_divide(F.covar_pop("_a", "_b").over(v), F.var_pop("_a").over(v)), F.lit(0.0))
    return out.withColumn("ta_beta", F.when(F.count("_a").over(v) >= 5, beta)).drop("_a", "_b")


def moving_period(bars: DataFrame, least: int = 2, most: int = 30) -> DataFrame:
    """Mean of highs over as many bars as the low says, within bounds."""
    n = F.least(F.greatest(F.col(L), F.lit(float(least))), F.lit(float(most))).cast("int")
    values = F.collect_list(H).over(trailing(most))
    part = F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)
    mean = F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / n
    return bars.withColumn("ta_mavp", F.when(F.size(values) >= most, mean))


def frames(bars: DataFrame) -> DataFrame:
    """Every indicator that frames and lags express."""
    out = bars.withColumn("_n", F.row_number().over(bars_window()))
    out = out.withColumns(price_columns() | overlap_frames() | momentum_frames())
    for f in (cci, stochastics, ultimate, macd_plain, regression, pair_statistics, moving_period):
        out = f(out)
    return out.drop("_n")


# Scans.


def ema(bars: DataFrame, series: dict[str, tuple[str, int]]) -> DataFrame:
    """name -> (input, n): seeded with the mean of the first n values."""
    return scan.seeded_ewma(bars, {k: (x, 2.0 / (n + 1), n) for k, (x, n) in series.items()})


def ema_family(bars: DataFrame, n: int = 30, t3: int = 5, v: float = 0.7) -> DataFrame:
    """EMA, DEMA, TEMA, T3 and TRIX from chains of exponential means; each link is written, so that no plan holds more than one."""
    out = ema(bars, {"_e1": (C, n), "_t1": (C, t3)})
    out = ema(cut(out), {"_e2": ("_e1", n), "_t2": ("_t1", t3)})
    out = ema(cut(out), {"_e3": ("_e2", n), "_t3": ("_t2", t3)})
    for i in (4, 5, 6):
        out = ema(cut(out), {f"_t{i}": (f"_t{i - 1}", t3)})
    e1, e2, e3 = (F.col(f"_e{i}") for i in (1, 2, 3))
    t = [F.col(f"_t{i}") for i in range(1, 7)]
    c1, c2, c3, c4 = -(v**3), 3 * v * v + 3 * v**3, -6 * v * v - 3 * v - 3 * v**3, 1 + 3 * v + v**3 + 3 * v * v
    out = out.withColumns({"ta_ema": e1, "ta_dema": 2 * e1 - e2, "ta_tema": 3 * e1 - 3 * e2 + e3, "ta_t3": c1 * t[5] + c2 * t[4] + c3 * t[3] + c4 * t[2], "ta_trix": (F.try_divide(e3, lag("_e3")) - 1) * 100})
    return out.drop("_e1", "_e2", "_e3", *[f"_t{i}" for i in range(1, 7)])


def macd_ema(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Both means are seeded where the slow one is; the fixed variant has the classic factors 0.15 and 0.075."""
    seed = F.when(F.row_number().over(bars_window()) > slow - fast, F.col(C))
    out = bars.withColumn("_late", seed)
    out = scan.seeded_ewma(out, {"_f": ("_late", 2 / (fast + 1), fast), "_s": (C, 2 / (slow + 1), slow), "_ff": ("_late", 0.15, fast), "_fs": (C, 0.075, slow)})
    out = out.withColumns({"ta_macd_0": F.col("_f") - F.col("_s"), "ta_macdfix_0": F.col("_ff") - F.col("_fs")})
    out = ema(cut(out), {"ta_macd_1": ("ta_macd_0", signal), "ta_macdfix_1": ("ta_macdfix_0", signal)})
    return out.withColumns({"ta_macd_2": F.col("ta_macd_0") - F.col("ta_macd_1"), "ta_macdfix_2": F.col("ta_macdfix_0") - F.col("ta_macdfix_1")}).drop("_late", "_f", "_s", "_ff", "_fs")


def directional(bars: DataFrame, n: int = 14) -> DataFrame:
    """RSI, CMO, ATR, NATR, TRANGE, directional movement and its indices, by Wilder's means."""
    step, up, down = F.col(C) - lag(C), F.col(H) - lag(H), lag(L) - F.col(L)
    after = lag(C).isNotNull()
    tr = F.when(after, F.greatest(F.col(H) - F.col(L), F.abs(F.col(H) - lag(C)), F.abs(F.col(L) - lag(C))))
    zero = F.lit(0.0)
    when = lambda c, x: F.when(after, F.when(c, x).otherwise(0.0))
    out = bars.withColumns({"_g": F.when(after, F.greatest(step, zero)), "_l": F.when(after, F.greatest(-step, zero)), "ta_trange": tr, "_p": when((up > down) & (up > 0), up), "_m": when((down > up) & (down > 0), down)})
    out = scan.seeded_ewma(out, {"_ag": ("_g", 1 / n, n), "_al": ("_l", 1 / n, n), "ta_atr": ("ta_trange", 1 / n, n), "_ap": ("_p", 1 / n, n), "_am": ("_m", 1 / n, n)})
    g, lo, atr, p, m = (F.col(x) for x in ("_ag", "_al", "ta_atr", "_ap", "_am"))
    ratio = lambda a, b: F.when(a.isNotNull(), F.coalesce(F.try_divide(a, b), zero))
    out = out.withColumns({"ta_rsi": 100 * ratio(g, g + lo), "ta_cmo": 100 * ratio(g - lo, g + lo), "ta_natr": 100 * ratio(atr, F.col(C)), "ta_plus_dm": p * n, "ta_minus_dm": m * n, "ta_plus_di": 100 * ratio(p, atr), "ta_minus_di": 100 * ratio(m, atr)})
    out = out.withColumn("ta_dx", 100 * ratio(F.abs(F.col("ta_plus_di") - F.col("ta_minus_di")), F.col("ta_plus_di") + F.col("ta_minus_di")))
    out = scan.wilder(cut(out), "ta_adx", "ta_dx", n)
    low, high = rolling(F.min, "ta_rsi", 14), rolling(F.max, "ta_rsi", 14)
    out = out.withColumns({"ta_adxr": (F.col("ta_adx") + lag("ta_adx", n - 1)) / 2, "ta_stochrsi_0": F.when(high > low, 100 * (F.col("ta_rsi") - low) / (high - low)).when(high.isNotNull(), 0.0)})
    return out.withColumn("ta_stochrsi_1", rolling_mean("ta_stochrsi_0", 3)).drop("_g", "_l", "_p", "_m", "_ag", "_al", "_ap", "_am")


def scans(bars: DataFrame) -> DataFrame:
    return directional(cut(macd_ema(cut(ema_family(bars)))))


# Walks.


def kama_machine(n: int = 30, fast: int = 2, slow: int = 30):
    a, b = 2 / (fast + 1), 2 / (slow + 1)

    def machine():
        seen: list[float] = []
        value: float | None = None

        def step(close) -> float | None:
            nonlocal value
            if close is None:
                return value
            seen.append(close)
            if len(seen) <= n:
                return None
            path = sum(abs(y - x) for x, y in zip(seen[-n - 1 :], seen[-n:]))
            share = min(1.0, abs(close - seen[-n - 1]) / path) if path else 1.0
            k = (share * (a - b) + b) ** 2
            value = (seen[-2] if value is None else value) + k * (close - (seen[-2] if value is None else value))
            del seen[: len(seen) - n - 1]
            return value

        return step

    return machine


def sar_machine(start: float = 0.02, most: float = 0.2):
    """Stop and reverse; ``signed``: the extended form reports stops of short positions as negative."""

    def machine():
        prev: tuple[float, float] | None = None
        long, sar, extreme, factor, ready = True, 0.0, 0.0, start, False

        def step(high, low) -> tuple[float | None, float | None]:
            nonlocal prev, long, sar, extreme, factor, ready
            if high is None or low is None:
                return None, None
            if prev is None:
                prev = (high, low)
                return None, None
            if not ready:
                up, down = high - prev[0], prev[1] - low
                long = not (down > up and down > 0)
                sar, extreme, ready = (prev[1], high, True) if long else (prev[0], low, True)
            out: float
            if long and low <= sar or not long and high >= sar:
                long = not long
                out = max(extreme, prev[0], high) if not long else min(extreme, prev[1], low)
                factor, extreme = start, low if not long else high
                sar = out + factor * (extreme - out)
                sar = max(sar, prev[0], high) if not long else min(sar, prev[1], low)
            else:
                out = sar
                if long and high > extreme or not long and low < extreme:
                    extreme, factor = high if long else low, min(most, factor + start)
                sar = sar + factor * (extreme - sar)
                sar = min(sar, prev[1], low) if long else max(sar, prev[0], high)
            prev = (high, low)
            return out, out if long else -out

        return step

    return machine


def cycle_machine(fast: float = 0.5, slow: float = 0.05):
    """Dominant cycle of the price by a homodyne discriminator on its Hilbert transform (after Ehlers), and what follows from it:
    period, phase, trend line, trend mode, and the adaptive means."""

    def machine():
        price: list[float] = []
        smooth, detrend, q1, i1 = ([0.0] * 7 for _ in range(4))
        i2 = q2 = re = im = period = smoothed = 0.0
        phase_before = mama = fama = 0.0
        lines: list[float] = []
        days, sine_before, lead_before, dc_before = 0, 0.0, 0.0, 0.0
        n = 0

        def hilbert(x: list[float], k: float) -> float:
            return (0.0962 * (x[-1] - x[-7]) + 0.5769 * (x[-3] - x[-5])) * k

        def push(x: list[float], v: float) -> None:
            x.append(v)
            del x[0]

        history: list[float] = []

        def step(close):
            nonlocal i2, q2, re, im, period, smoothed, phase_before, mama, fama, days, sine_before, lead_before, dc_before, n
            if close is None:
                return (None,) * 7
            n += 1
            price.append(close)
            if len(price) < 4:
                return (None,) * 7
            value = (4 * price[-1] + 3 * price[-2] + 2 * price[-3] + price[-4]) / 10
            del price[: len(price) - 51]
            push(smooth, value)
            history.append(value)
            del history[: len(history) - 60]
            k = 0.075 * period + 0.54
            push(detrend, hilbert(smooth, k))
            push(q1, hilbert(detrend, k))
            push(i1, detrend[-4])
            ji, jq = hilbert(i1, k), hilbert(q1, k)
            a, b = 0.2 * (i1[-1] - jq) + 0.8 * i2, 0.2 * (q1[-1] + ji) + 0.8 * q2
            re, im = 0.2 * (a * i2 + b * q2) + 0.8 * re, 0.2 * (a * q2 - b * i2) + 0.8 * im
            i2, q2 = a, b
            last = period
            if re and im and math.atan(im / re):
                period = 2 * math.pi / math.atan(im / re)
            period = min(max(period, 0.67 * last), 1.5 * last) if last else period
            period = 0.2 * min(max(period, 6.0), 50.0) + 0.8 * last
            smoothed = 0.33 * period + 0.67 * smoothed
            phase = math.degrees(math.atan(q1[-1] / i1[-1])) if i1[-1] else phase_before
            turn = max(phase_before - phase, 1.0)
            alpha = min(max(fast / turn, slow), fast)
            phase_before = phase
            mama = close if n <= 5 else alpha * close + (1 - alpha) * mama
            fama = close if n <= 5 else alpha / 2 * mama + (1 - alpha / 2) * fama
            size = max(1, int(smoothed + 0.5))
            part = history[-size:]
            real = sum(math.sin(math.radians(360 * i / size)) * v for i, v in enumerate(reversed(part)))
            imag = sum(math.cos(math.radians(360 * i / size)) * v for i, v in enumerate(reversed(part)))
            dc = math.degrees(math.atan2(real, imag)) if abs(imag) > 1e-12 or abs(real) > 1e-12 else 0.0
            dc = (dc + 90 + (360 / smoothed if smoothed else 0)) % 360
            dc = dc - 360 if dc > 315 else dc
            lines.append(sum(price[-size:]) / min(size, len(price)))
            del lines[: len(lines) - 4]
            line = (4 * lines[-1] + 3 * lines[-2] + 2 * lines[-3] + lines[-4]) / 10 if len(lines) == 4 else lines[-1]
            sine, lead = math.sin(math.radians(dc)), math.sin(math.radians(dc + 45))
            trend = 1
            if (sine > lead and sine_before <= lead_before) or (sine < lead and sine_before >= lead_before):
                days, trend = 0, 0
            days += 1
            if days < 0.5 * smoothed:
                trend = 0
            turned = dc - dc_before
            if smoothed and 0.67 * 360 / smoothed < turned < 1.5 * 360 / smoothed:
                trend = 0
            if line and abs((value - line) / line) >= 0.015:
                trend = 1
            sine_before, lead_before, dc_before = sine, lead, dc
            if n <= 32:
                return (None,) * 7
            ready = n > 63
            return smoothed, dc if ready else None, line if ready else None, trend if ready else None, mama, fama, sine if ready else None

        return step

    return machine


def walks(bars: DataFrame) -> DataFrame:
    """Indicators whose state is more than a linear recurrence: each symbol's bars stream through a bounded machine."""
    keep = bars.columns
    kama, sar, cycle = kama_machine(), sar_machine(), cycle_machine()

    def machine():
        k, s, c = kama(), sar(), cycle()
        return lambda high, low, close: (k(close), *s(high, low), *c(close)[:6])

    return walk(bars, machine, [H, L, C], "ta_kama double, ta_sar double, ta_sarext double, ta_ht_dcperiod double, ta_ht_dcphase double, ta_ht_trendline double, ta_ht_trendmode double, ta_mama_0 double, ta_mama_1 double", keep)


# Normalization.

OSCILLATORS = ("rsi", "mfi", "adx", "cci", "cmo", "dx", "minus_di", "plus_di", "ppo", "apo", "aroon", "willr", "ultosc", "stoch", "beta", "correl")
LEVELS = ("bbands", "dema", "ema", "ht_trendline", "kama", "ma", "mama", "mavp", "midpoint", "midprice", "sar", "sarext", "sma", "t3", "tema", "trima", "wma", "medprice", "typprice", "wclprice", "mom", "tsf")


def kind_of(column: str) -> str:
    """How an indicator is normalized: pattern, level, oscillator or plain."""
    name = column.removeprefix("ta_")
    if name.startswith("cdl"):
        return "pattern"
    base = name.rstrip("0123456789").rstrip("_") if name.rsplit("_", 1)[-1].isdigit() else name
    if base in LEVELS:
        return "level"
    if any(x in base for x in OSCILLATORS):
        return "oscillator"
    return "level" if base.startswith("linearreg") else "plain"


def normalized(df: DataFrame, columns: list[str], atr: str = "ta_atr", causal: bool = False, kinds: dict[str, str] | None = None) -> DataFrame:
    """Each column by its kind, with the symbol's moments over all rows, or over the rows so far.

    ``kinds`` overrides ``kind_of``; two kinds are only reached so: ``skewed_positive`` (the logarithm is scored) and ``mask`` (kept as it is, like a pattern).
    """
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0 if causal else Window.unboundedFollowing)

    def z(x: Column, bound: float) -> Column:
        sd = F.stddev_pop(x).over(w)
        return F.when(x.isNotNull(), F.when(sd > 0, clip((x - F.avg(x).over(w)) / sd, -bound, bound)).otherwise(0.0))

    out = {}
    for c in columns:
        kind, x = (kinds or {}).get(c) or kind_of(c), F.col(c)
        if kind == "oscillator":
            out[c] = F.when(F.min(x).over(w) < -50, clip((x + 50) / 50, -1, 1)).otherwise(clip((x - 50) / 50, -1, 1))
        elif kind == "level":
            out[c] = z((x - F.col(C)) / (F.col(atr) + 1e-8), 6.0)
        elif kind == "skewed_positive":
            out[c] = z(F.when(x.isNotNull(), F.log(F.greatest(x, F.lit(1e-8)))), 5.0)
        elif kind == "plain":
            out[c] = z(x, 5.0)
    return df.withColumns(out)


__all__ = ["correlation", "frames", "kind_of", "normalized", "scans", "walks"]
