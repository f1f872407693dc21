"""Split, scaling, fitness and guards of formulas as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import to_column
from ..functions.series import quantile

#: Weights of the fitness (fixed values).
PEARSON, DIRECTION, WRONG, SPREAD_FLOOR, SPREAD = 0.70, 0.30, 0.25, 0.08, 5.0
REJECTED = -9999.0


def temporal_split(df: DataFrame, horizon: int, share: float = 0.8, key: str = "symbol", order: str = "ts") -> DataFrame:
    """``part``: train up to ``horizon`` rows before the split, embargo, then holdout; a symbol with too few rows has no part."""
    w = Window.partitionBy(key)
    i, n = F.row_number().over(w.orderBy(order)) - 1, F.count("*").over(w)
    out = df.withColumns({"_i": i, "_n": n})
    split = F.floor(F.col("_n") * share)
    part = F.when(split <= horizon, None).when(F.col("_i") < split - horizon, "train").when(F.col("_i") < split, "embargo").otherwise("holdout")
    return out.withColumn("part", part).drop("_i", "_n")


def walk_forward(df: DataFrame, start: str, train_months: int, test_months: int, folds: int, purge: int, key: str = "symbol", order: str = "ts") -> DataFrame:
    """Rows of each fold with ``fold`` and ``part``; the last ``purge`` rows of a training window are left out."""
    k = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    out = df.withColumn("fold", k)
    first = F.add_months(F.lit(start).cast("date"), (F.col("fold") * test_months).cast("int"))
    out = out.withColumns({"_a": first, "_b": F.add_months(first, train_months), "_c": F.add_months(first, train_months + test_months)})
    day = F.col(order).cast("date")
    out = out.withColumn("part", F.when((day >= F.col("_a")) & (day < F.col("_b")), "train").when((day >= F.col("_b")) & (day < F.col("_c")), "test")).where("part is not null")
    left = F.row_number().over(Window.partitionBy(key, "fold", "part").orderBy(F.desc(order)))
    return out.withColumn("_left", left).where((F.col("part") == "test") | (F.col("_left") > purge)).drop("_a", "_b", "_c", "_left")


def fit_tanh(train: DataFrame, columns: list[str], key: str = "symbol", exact: bool = True) -> DataFrame:
    """A scale per column and symbol: the upper quartile of absolute values."""
    return train.groupBy(key).agg(*[F.greatest(quantile(F.abs(c), 0.75, exact), F.lit(1e-8)).alias(f"_scale_{c}") for c in columns])


def apply_tanh(df: DataFrame, fitted: DataFrame, columns: list[str], key: str = "symbol") -> DataFrame:
    """tanh(x / scale) as float in place of each column; the order of columns stays."""
    out = df.join(fitted, key, "left")
    return out.select(*[F.tanh(F.col(c) / F.col(f"_scale_{c}")).cast("float").alias(c) if c in columns else F.col(c) for c in df.columns])


def fitness(y: str | Column, p: str | Column, pearson: float = PEARSON, direction: float = DIRECTION) -> Column:
    """One aggregate: correlation, harmonic mean of both sides' hit shares, less wrong-sign size and lack of spread."""
    y, p = (F.col(x) if isinstance(x, str) else x for x in (y, p))
    y, p = y.cast("double"), p.cast("double")
    n = F.count(p)
    sy, sp = F.stddev_pop(y), F.stddev_pop(p)
    corr = F.when(sp < 1e-9, 0.0).otherwise(F.covar_pop(y, p) * n / (sy * sp * n + 1e-8))
    long = F.count_if((y == 1) & (p > 0)) / (F.count_if(y == 1) + 1e-8)
    short = F.count_if((y == -1) & (p < 0)) / (F.count_if(y == -1) + 1e-8)
    both = 2 * long * short / (long + short + 1e-8)
    zero = F.lit(0.0)
    wrong = F.coalesce(F.avg(F.when(y == 1, F.greatest(zero, -p))), zero) + F.coalesce(F.avg(F.when(y == -1, F.greatest(zero, p))), zero)
    return pearson * corr + direction * both - WRONG * wrong / 2 - SPREAD * F.greatest(zero, SPREAD_FLOOR - sp)


def shallow_penalty(nodes: int, features: int, least_nodes: int = 8, least_features: int = 3) -> float:
    return 0.02 * max(0, least_nodes - nodes) + 0.15 * max(0, least_features - features)


def score_formulas(df: DataFrame, formulas: list[str], y: str, keys: list[str] | None = None) -> DataFrame:
    """A row per formula (and key) with its fitness: all formulas in one pass over the rows."""
    aggs = [fitness(y, to_column(f)).alias(f"f{i}") for i, f in enumerate(formulas)]
    wide = df.groupBy(*(keys or [])).agg(*aggs)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("formula"), F.col(f"f{i}").alias("fitness")) for i, f in enumerate(formulas)])).alias("x")
    return wide.select(*(keys or []), pairs).select(*(keys or []), "x.*")


def signal_quality(df: DataFrame, x: str, key: str = "symbol", upper: float = 0.85, lower: float = 0.15, least_unique: float = 0.10, least_sep: float = 0.05, exact: bool = True) -> DataFrame:
    """Per symbol: share of different values, entropy of a histogram of 20 bins, coverage at both ends, and the verdict."""
    col = F.col(x).cast("double")
    w = Window.partitionBy(key)
    binned = df.select(key, col.alias("_x"), F.min(col).over(w).alias("_lo"), F.max(col).over(w).alias("_hi"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 20), F.lit(19))).otherwise(10)
    counts = binned.withColumn("_bin", place).groupBy(key, "_bin").agg(F.count("*").alias("n"))
    p = F.col("n") / (F.sum("n").over(w) + 1e-8)
    entropy = counts.withColumn("p", p).groupBy(key).agg((-F.sum(F.col("p") * F.ln(F.col("p") + 1e-8)) / math.log(20)).alias("norm_entropy"))
    stats = binned.groupBy(key).agg(
        (F.count_distinct(F.bround("_x", 5)) / F.count("*")).alias("unique_ratio"), quantile("_x", upper, exact).alias("entry"), quantile("_x", lower, exact).alias("exit")
    )
    cover = binned.join(stats, key).groupBy(key).agg(F.avg((F.col("_x") >= F.col("entry")).cast("int")).alias("long_cov"), F.avg((F.col("_x") <= F.col("exit")).cast("int")).alias("short_cov"))
    out = stats.join(entropy, key).join(cover, key)
    one_sided = ((F.col("long_cov") > 0.55) & (F.col("short_cov") < 0.03)) | ((F.col("short_cov") > 0.55) & (F.col("long_cov") < 0.03))
    bad = (F.col("unique_ratio") < least_unique) | (F.col("norm_entropy") < 0.25) | one_sided | (F.col("entry") - F.col("exit") < least_sep)
    return out.withColumn("good", ~bad)
