"""Window expressions over one symbol's bars in order of time.

Missing values are NULL, never NaN. All frames share one partitioning and ordering, so any
number of them costs one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-10


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bars_window(keys: str | list[str] = "symbol", order: str = "ts") -> WindowSpec:
    return Window.partitionBy(keys).orderBy(order)


W = bars_window


def trailing(n: int | None = None, w: WindowSpec | None = None) -> WindowSpec:
    """The last n rows, or all rows so far."""
    return (w or bars_window()).rowsBetween(Window.unboundedPreceding if n is None else 1 - n, 0)


def lag(x: str | Column, k: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(c(x), k).over(w or bars_window()) if k >= 0 else F.lead(c(x), -k).over(w or bars_window())


def diff(x: str | Column, k: int = 1) -> Column:
    return c(x) - lag(x, k)


def rolling(agg, x: str | Column, n: int, least: int | None = None, w: WindowSpec | None = None) -> Column:
    """``agg`` over the last n rows; NULL unless ``least`` values (all n by default) are there."""
    frame = trailing(n, w)
    return F.when(F.count(c(x)).over(frame) >= (n if least is None else least), agg(c(x)).over(frame))


def rolling_mean(x, n, least=None):
    return rolling(F.avg, x, n, least)


def rolling_std(x, n, least=None):
    return rolling(F.stddev_samp, x, n, least)


def log_return(x: str | Column = "close") -> Column:
    return F.ln(c(x) / lag(x))


def simple_return(x: str | Column = "close") -> Column:
    before = lag(x)
    return (c(x) - before) / F.greatest(before, F.lit(1e-12))


def cumulative_log_return(h: int, x: str | Column = "close") -> Column:
    """ln(x_t / x_{t-h}): the sum of the last h log returns."""
    return F.ln(c(x) / lag(x, h))


def true_range() -> Column:
    """The widest of the bar's range and its distances from the last close; the first bar's own range."""
    before = lag("close")
    return F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before))


def clip(x: Column, lo: float, hi: float) -> Column:
    """NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def midpoint(n: int) -> Column:
    return (rolling(F.max, "high", n) + rolling(F.min, "low", n)) / 2


def rank_in(x: str | Column, n: int, least: int = 1) -> Column:
    """Percentile rank of the last value among the last n, ties averaged, as a share of the values there."""
    values = F.collect_list(c(x)).over(trailing(n))
    below = F.size(F.filter(values, lambda v: v < c(x)))
    same = F.size(F.filter(values, lambda v: v == c(x)))
    return F.when(c(x).isNotNull() & (F.size(values) >= least), (below + (same + 1) / 2) / F.size(values))


def numbered(df: DataFrame, name: str = "n") -> DataFrame:
    """Rows numbered from 1 within their symbol."""
    return df.withColumn(name, F.row_number().over(bars_window()))


def drawdown(x: str | Column, w: WindowSpec | None = None) -> Column:
    """Distance from the highest value so far, as a share of it."""
    top = F.max(c(x)).over(trailing(None, w))
    return (c(x) - top) / top


def compounded(rate: str | Column, w: WindowSpec | None = None) -> Column:
    """Product of 1 + rate over the rows so far, for rates above -1."""
    return F.exp(F.sum(F.log1p(c(rate))).over(trailing(None, w)))


def replace_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities of double columns become NULL."""
    fix = {n: F.when(~F.isnan(n) & (F.abs(F.col(n)) < float("inf")), F.col(n)) for n, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(fix) if fix else df


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's correlation over rows that have both; NULL, not an error, where either does not vary."""
    a = F.when(c(y).isNotNull(), c(x).cast("double"))
    b = F.when(c(x).isNotNull(), c(y).cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def quantile(x: str | Column, share: float, exact: bool = True) -> Column:
    """A quantile as an aggregate. The exact one interpolates and holds a group's different values in memory; for groups of
    billions, the other has a bounded sketch with a rank error below 1e-5."""
    return F.percentile(c(x), F.lit(share)) if exact else F.percentile_approx(c(x), F.lit(share), F.lit(100_000))
