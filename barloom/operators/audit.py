"""Audits of bars, labels and features: counts, distributions, leakage, scale, collinearity, information and drift.

Features are audited in long form (symbol, ts, feature, value): one unpivot, and every figure is a grouped aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import correlation, lag, quantile, simple_return

PRICES = ["open", "high", "low", "close"]


def integrity(bars: DataFrame) -> DataFrame:
    """Per symbol: rows, missing values, repeats, price violations and steps back in time."""
    w = Window.partitionBy("symbol").orderBy("ts")
    outside = lambda c: F.count_if((F.col(c) > F.col("high")) | (F.col(c) < F.col("low")))
    row = F.struct("ts", *PRICES)
    own = bars.withColumn("_d", F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")))
    return own.groupBy("symbol").agg(
        F.count("*").alias("rows"),
        F.count_if(F.expr(" or ".join(f"{p} is null" for p in PRICES))).alias("null_rows"),
        (F.count("*") - F.count_distinct(row)).alias("duplicated_rows"),
        (F.count("*") - F.count_distinct("ts")).alias("duplicated_timestamps"),
        F.count_if(F.col("high") < F.col("low")).alias("high_lt_low"),
        outside("open").alias("open_outside_hl"),
        outside("close").alias("close_outside_hl"),
        F.count_if(F.least(*PRICES) <= 0).alias("nonpositive_prices"),
        F.count_if(F.col("_d") <= 0).alias("non_monotonic"),
    )


def top_deltas(bars: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent steps in time of each symbol, in seconds."""
    w = Window.partitionBy("symbol").orderBy("ts")
    d = bars.select("symbol", F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")).alias("seconds")).where("seconds is not null")
    by = d.groupBy("symbol", "seconds").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("n"), "seconds"))
    return by.withColumn("place", place).where(F.col("place") <= k)


def target_distribution(df: DataFrame, x: str, flat: float = 0.02, key: str = "symbol") -> DataFrame:
    c, a = F.col(x).cast("double"), F.abs(F.col(x).cast("double"))
    between = lambda lo, hi: F.count_if((a >= lo) & (a < hi))
    return df.groupBy(key).agg(
        F.count("*").alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("most"), F.count_if(c == 0).alias("exact_zero"), F.count_if(a <= 1e-12).alias("eps_zero"),
        F.count_if(a < 1e-8).alias("lt_1e8"), F.count_if(a < 1e-6).alias("lt_1e6"), F.count_if((a > 0) & (a < 0.01)).alias("to_01"), between(0.01, 0.03).alias("to_03"), between(0.03, 0.05).alias("to_05"), between(0.05, 0.10).alias("to_10"),
        F.count_if(a >= 0.10).alias("from_10"), F.count_if(a <= flat).alias("flat"), F.count_if(c > 0).alias("positive"), F.count_if(c < 0).alias("negative"),
    )


def examples(df: DataFrame, cases: dict[str, Column], n: int = 10, key: str = "symbol", order: str = "ts") -> DataFrame:
    """The first ``n`` rows of each case and symbol."""
    kinds = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in cases.items()]))).alias("case")
    out = df.select("*", kinds)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(key, "case").orderBy(order))).where(F.col("place") <= n)


def label_correlations(df: DataFrame, y: str, most_lag: int = 3, key: str = "symbol") -> DataFrame:
    """Correlation of labels with returns after, before and at the bar; the largest of the last two kinds is the risk of leakage."""
    r = df.withColumn("_r", simple_return())
    lags = {f"fwd_{k}": -k for k in range(1, most_lag + 1)} | {f"past_{k}": k for k in range(1, most_lag + 1)} | {"same_bar": 0}
    r = r.withColumns({f"_{n}": lag("_r", k) if k else F.col("_r") for n, k in lags.items()})
    corr = lambda n: F.when(F.count_if(F.col(f"_{n}").isNotNull() & F.col(y).isNotNull()) > 10, correlation(f"_{n}", y))
    out = r.groupBy(key).agg(*[corr(n).alias(n) for n in lags])
    back = [F.abs(n) for n in lags if not n.startswith("fwd")]
    return out.withColumn("leakage_risk", F.coalesce(F.greatest(*back), F.lit(0.0)))


def outcome_rates(labels: DataFrame, key: str = "symbol") -> DataFrame:
    n = F.count("*")
    share = lambda *k: F.count_if(F.col("event_type").isin(*k)) / n
    tp, sl = share("LONG_TP", "SHORT_TP", "BOTH_TP"), share("LONG_SL", "SHORT_SL", "BOTH_SL")
    out = labels.where("is_valid").groupBy(key).agg(tp.alias("tp_hit_rate"), sl.alias("sl_first_rate"), share("TIMEOUT").alias("timeout_rate"), share("AMBIGUOUS", "WIDE_CANDLE").alias("neutral_rate"))
    return out.withColumn("anomaly", (F.col("sl_first_rate") == 0) & (F.col("tp_hit_rate") > 0))


def label_audit(labels: DataFrame, key: str = "symbol") -> DataFrame:
    """Counts of labels and events and the mean bars held after the entry bar."""
    code = lambda *k: F.count_if(F.col("event_code").isin(*k))
    t = lambda v: F.count_if(F.col("target") == v)
    out = labels.where("is_valid").groupBy(key).agg(
        F.count("*").alias("n_total"), t(1).alias("n_long"), t(-1).alias("n_short"), t(0).alias("n_neutral"), t(-99).alias("n_whipsaw"), code(1, 2).alias("tp_count"), code(3, 4).alias("sl_count"),
        code(8).alias("timeout_count"), code(5).alias("both_tp_count"), code(6).alias("both_sl_count"), code(7).alias("ambiguous_count"), code(9).alias("wide_candle_count"), F.avg(F.col("event_bar_pos") - (F.col("pos") + 1)).alias("avg_hold"),
    )
    return out.withColumn("signal_pct", (F.col("n_long") + F.col("n_short")) / F.greatest("n_total", F.lit(1)))


def forward_windows(labels: DataFrame, bars: DataFrame, horizon: int, decisions: int = 8) -> DataFrame:
    """The bars from each of a symbol's first decisions to its horizon: one bounded range join."""
    first = labels.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))).where(F.col("_k") <= decisions).select("symbol", F.col("ts").alias("decision"), F.col("_k").alias("k"))
    rows = bars.withColumn("_i", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")))
    at = first.join(rows.select("symbol", F.col("ts").alias("decision"), F.col("_i").alias("_at")), ["symbol", "decision"])
    out = at.select("symbol", "decision", "k", F.explode(F.transform(F.sequence(F.lit(0), F.lit(horizon)), lambda s: F.struct(s.alias("step"), (F.col("_at") + s).alias("i")))).alias("x"))
    return out.select("symbol", "decision", "k", "x.step", F.col("x.i").alias("_i")).join(rows, ["symbol", "_i"]).drop("_i")


def long_form(df: DataFrame, features: list[str], extra: list[str] | None = None) -> DataFrame:
    return df.select("symbol", "ts", *(extra or []), *[F.col(f).cast("double") for f in features]).unpivot(["symbol", "ts", *(extra or [])], features, "feature", "value")


def feature_report(long: DataFrame) -> DataFrame:
    """Per feature: missing share, whether it is dead, moments, and the share stuck at the scaler's bounds unless it has two values."""
    v = F.col("value")
    out = long.groupBy("feature").agg(
        F.avg(v.isNull().cast("int")).alias("nan_pct"), F.count_distinct(v).alias("n_unique"), F.stddev_samp(v).alias("std"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg((F.abs(v) >= 0.999).cast("int")).alias("_sat")
    )
    return out.withColumns({"dead": F.col("n_unique") <= 1, "saturated_pct": F.when(F.col("n_unique") > 2, F.col("_sat"))}).drop("_sat")


def scale_dominance(report: DataFrame) -> DataFrame:
    s = report.where("std > 0")
    out = s.agg(F.max("std").alias("max_std"), F.min("std").alias("min_std"), F.percentile("std", F.lit(0.5)).alias("median_std"))
    return out.withColumn("max_over_median", F.col("max_std") / F.col("median_std")).withColumn("ok", F.coalesce(F.col("max_over_median") <= 20, F.lit(True)))


def target_corr(long: DataFrame, y: str) -> DataFrame:
    """feature, corr with ``y`` over all rows where both are there."""
    both = long.where(F.col("value").isNotNull() & F.col(y).isNotNull())
    return both.groupBy("feature").agg(correlation("value", y).alias("corr"))


def predictive_dominance(corrs: DataFrame) -> DataFrame:
    """The best feature, its correlation, and how far it leads the second."""
    top = corrs.where("corr is not null").orderBy(F.desc(F.abs("corr")), "feature").limit(2).agg(F.array_sort(F.collect_list(F.struct((-F.abs("corr")).alias("k"), "feature", "corr"))).alias("t"))
    a, b = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    return top.select(a["feature"].alias("feature"), a["corr"].alias("corr"), F.try_divide(a["k"], b["k"]).alias("top_over_second")).withColumn("ok", F.coalesce(F.col("top_over_second") <= 3, F.lit(True)))


def collinear_pairs(df: DataFrame, features: list[str], least: float = 0.95) -> DataFrame:
    """Pairs of complete features with a correlation of ``least`` or more, all in one aggregate over the rows."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    whole = {f: (F.count("*") == F.count(f)) for f in features}
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(whole[a] & whole[b], correlation(a, b)).alias("corr")) for a, b in pairs]
    out = df.agg(F.array(*cells).alias("p")).select(F.explode("p").alias("x")).select("x.*")
    return out.where(F.abs("corr") >= least)


def readiness(df: DataFrame, features: list[str], y: str, horizon: int, share: float = 0.8) -> DataFrame:
    """Per symbol: rows, missing shares over 5 %, dead features, features that tell the target, and the split's sizes."""
    n = F.count("*")
    listed = lambda cond: F.array_compact(F.array(*[F.when(cond(f), F.lit(f)) for f in features]))
    out = df.groupBy("symbol").agg(
        n.alias("rows"),
        listed(lambda f: F.avg(F.col(f).isNull().cast("int")) > 0.05).alias("high_nan"),
        listed(lambda f: F.count_distinct(f) <= 1).alias("dead"),
        listed(lambda f: F.abs(correlation(f, y)) > 0.95).alias("leaky"),
        (n - F.count_distinct("ts")).alias("repeated_times"),
    )
    split = F.floor(F.col("rows") * share)
    out = out.withColumns({"train_rows": F.greatest(split - horizon, F.lit(0)), "holdout_rows": F.col("rows") - split})
    bad = F.array_compact(F.array(F.when(F.size("high_nan") > 0, "missing"), F.when(F.size("dead") > 0, "dead"), F.when(F.size("leaky") > 0, "leakage"), F.when(split <= horizon, "split"), F.when(F.col("repeated_times") > 0, "alignment")))
    return out.withColumn("flags", F.array_join(bad, ",")).withColumns({c: F.array_join(c, ",") for c in ("high_nan", "dead", "leaky")})


def profile(long: DataFrame, keys: tuple[str, ...] = ("feature",), exact: bool = True) -> DataFrame:
    """Mean, deviation, bias-corrected skewness and excess kurtosis, quantiles and shares beyond 0.95 and 0.99."""
    v = F.col("value")
    out = long.where(v.isNotNull()).groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.skewness(v).alias("_g"), F.kurtosis(v).alias("_k"), quantile(v, 0.25, exact).alias("p25"), quantile(v, 0.75, exact).alias("p75"), quantile(v, 0.99, exact).alias("p99"),
        F.avg((F.abs(v) > 0.95).cast("int")).alias("over_95"), F.avg((F.abs(v) > 0.99).cast("int")).alias("over_99"),
    )
    n = F.col("n")
    skew = F.when(n > 2, F.col("_g") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_k") + 6))
    return out.withColumns({"skew": skew, "kurtosis": kurt}).drop("_g", "_k")


#: Bounds by construction (fixed values).
BOUNDS = {
    "feat_efficiency": (-1.0, 1.0), "feat_icp": (-1.0, 1.0), "feat_momentum_rsi": (-1.0, 1.0), "feat_vol_asymmetry": (-1.0, 1.0), "feat_local_structure": (-1.0, 1.0),
    "feat_session_sin": (-1.0, 1.0), "feat_session_cos": (-1.0, 1.0), "feat_rejection_upper": (0.0, 1.0), "feat_rejection_lower": (0.0, 1.0),
}


def bounds_compliance(long: DataFrame, bounds: dict[str, tuple[float, float]] = BOUNDS) -> DataFrame:
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for f, b in bounds.items() for x in (f, b[i])]), F.col("feature"))
    v = F.col("value")
    own = long.where(F.col("feature").isin(*bounds) & v.isNotNull()).withColumns({"lo": pick(0), "hi": pick(1)})
    out = own.groupBy("feature").agg(F.min(v).alias("least"), F.max(v).alias("most"), F.avg(((v >= F.col("lo")) & (v <= F.col("hi"))).cast("int")).alias("in_bounds"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    return out.withColumns({"violates": 1 - F.col("in_bounds") > 0.001, "exceeds": (F.col("least") < F.col("lo") - 1e-4) | (F.col("most") > F.col("hi") + 1e-4)}).drop("lo", "hi")


def average_rank(x: str, keys: list[str]) -> Column:
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2


def correlations(long: DataFrame, y: str, keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """Pearson and rank correlation of values with ``y``."""
    both = long.where(F.col("value").isNotNull() & F.col(y).isNotNull()).withColumn("_y", F.col(y).cast("double"))
    both = both.withColumns({"_rx": average_rank("value", list(keys)), "_ry": average_rank("_y", list(keys))})
    return both.groupBy(*keys).agg(correlation("value", "_y").alias("pearson"), correlation("_rx", "_ry").alias("spearman"))


def codes(df: DataFrame, x: str, bins: int, keys: list[str]) -> DataFrame:
    """``code_x``: categories of a column with few values, else the place among its quantiles."""
    shares = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    stats = df.groupBy(*keys).agg(F.count_distinct(x).alias("_u"), F.percentile(x, shares).alias("_q"))
    out = df.join(stats, keys)
    inner = F.slice(F.array_distinct("_q"), 2, F.greatest(F.size(F.array_distinct("_q")) - 2, F.lit(0)))
    place = F.size(F.filter(inner, lambda e: e <= F.col(x)))
    few = F.dense_rank().over(Window.partitionBy(*keys).orderBy(x)) - 1
    return out.withColumn(f"code_{x}", F.when(F.col("_u") <= bins, few).otherwise(place)).drop("_u", "_q")


def mutual_information(long: DataFrame, y: str, bins: int = 20, keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """Nats that a binned value tells of a binned target."""
    both = long.where(F.col("value").isNotNull() & F.col(y).isNotNull()).withColumn("_y", F.col(y).cast("double"))
    coded = codes(codes(both, "value", bins, list(keys)), "_y", bins, list(keys))
    cells = coded.groupBy(*keys, "code_value", "code__y").agg(F.count("*").alias("n"))
    w = lambda *more: Window.partitionBy(*keys, *more)
    n = F.sum("n").over(w())
    cells = cells.withColumns({"p": F.col("n") / n, "px": F.sum("n").over(w("code_value")) / n, "py": F.sum("n").over(w("code__y")) / n})
    return cells.groupBy(*keys).agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("px") * F.col("py") + 1e-12) + 1e-12)).alias("mi"))


def drift(long: DataFrame, part: str = "part", a: str = "train", b: str = "holdout", keys: tuple[str, ...] = ("feature",), least: int = 20) -> DataFrame:
    """Largest gap of the distribution functions, the area between them, and the asymptotic p value of the gap."""
    both = long.where(F.col("value").isNotNull() & F.col(part).isin(a, b)).groupBy(*keys, "value").agg(F.count_if(F.col(part) == a).alias("_a"), F.count_if(F.col(part) == b).alias("_b"))
    whole, so_far = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    na, nb = F.sum("_a").over(whole), F.sum("_b").over(whole)
    step = both.withColumns({"na": na, "nb": nb, "gap": F.abs(F.sum("_a").over(so_far) / na - F.sum("_b").over(so_far) / nb), "width": F.lead("value").over(Window.partitionBy(*keys).orderBy("value")) - F.col("value")})
    out = step.where((F.col("na") >= least) & (F.col("nb") >= least)).groupBy(*keys).agg(F.max("gap").alias("ks"), F.sum(F.col("gap") * F.coalesce("width", F.lit(0.0))).alias("wasserstein"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    en = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))) * F.col("ks")
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + 2 * F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * en * en))
    return out.withColumn("ks_p", F.when(en < 0.04, 1.0).otherwise(F.least(F.greatest(terms, F.lit(0.0)), F.lit(1.0))))


LN20 = math.log(20)
